"""The PII query against a search of every place for every form."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import CLASH, LONG, VALUES, docs_of, prose

from tidemark.llm import pii

OTHERS = ["1234567890123", "4539148803436468", "999.1.1.1", "2021-13-45", "12/2021", "a@b", "٢٠٢١-٠٣-٠٤", "1,000", "+1", "v1.2.3", "#5", "10:30", "(", "/", "-", "99.99%"]
MORE = ["+44 20 7946 0958", "3782-822463-10005", "3.5.1971", "2020-1-2", "192.168.0.1", "GB29 NWBK 6016 1331 9268 19", "+4930901820", "bob@x.org", "1600-02-29"]


def brute(text, key=pii.KEY):
    """Each form tried at each place, in the order of the forms; overlapping ones are left to the first."""
    taken = []

    def add(start, end, new):
        if new is None or any(start < b and a < end for a, b, _ in taken):
            return False
        taken.append((start, end, new))
        return True

    for k in range(len(text)):
        m = pii._EMAIL.match(text, k)
        if m and (k == 0 or text[k - 1] not in pii._LOCAL):
            add(*m.span(), pii.email(m.group(), key))
    for k in range(len(text)):
        m = pii._IBAN.match(text, k)
        if m:
            v = m.group()
            ends = sorted([len(v), *(j for j in range(len(v) - 1, 14, -1) if v[j] == " ")], key=lambda j: len(v[:j].replace(" ", "")) != pii._LENGTHS.get(v[:2]))
            any(add(k, k + j, pii.iban(v[:j], key)) for j in ends)
    for _, form, change in pii._FORMS:
        at = 0
        for k in range(len(text)):
            m = form.match(text, k) if k >= at else None
            if m:
                v = m.group()
                at = m.end()
                while not add(k, k + len(v), change(v, key)) and change is pii.international and len(v) >= 9:
                    v = v.rstrip("0123456789").rstrip("".join(c for c in v if not c.isdigit()))
    out, last = "", 0
    for start, end, new in sorted(taken):
        out += text[last:start] + new
        last = end
    return out + text[last:], len(taken)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(31)
    every = VALUES + OTHERS + MORE
    out = [(k, "".join((r.choice(every) if r.random() < 0.5 else prose(r.randrange(3), r.randrange(10**6))) + r.choice([" ", ", ", "\n", " é ", ". "]) for _ in range(r.randrange(0, 14))), "a") for k in range(400)]
    return [*out, (900, f"{LONG} 415-555-2671 {prose(300, 1)}", "a"), (901, None, "a"), (None, "bob@x.org", "b"), (902, "", None), (0, out[0][1], "a")]


def test_query_is_brute_force(spark, rows):
    df = docs_of(spark, rows)
    for c in (*CLASH, "new", "kind"):
        df = df.withColumn(c, F.lit(1))
    got = pii.pseudonyms(df.repartition(3))
    assert got.columns == [*(c for c in df.columns if c != "replaced"), "replaced"]
    want = [(i, *((None, 0) if t is None else brute(t) if len(t) < 10_000 else (t.replace("415-555-2671", pii.phone("415-555-2671", pii.KEY)), 1))) for i, t, _ in rows]
    have = [(x["doc_id"], x["text"], x["replaced"]) for x in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert sum(n for *_, n in have) > 500
    first = {}
    for i, t, _ in have:
        first.setdefault(i, t)
    assert sum(pii.pseudonymize(first[i], back=True)[0] == t for i, t, _ in rows if t is not None) >= 0.98 * len(rows) - 2
