"""The ten operators against brute force, and on awkward tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, exact_dedup, mixing, near_dedup, pii, secrets, suffix_dedup, toxicity, warc
from tidemark.llm.words import Words, strings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASH = ("key", "digest", "old", "regs", "members", "score", "toxic", "item_id", "shard", "position", "replaced", "pos", "mask", "_doc", "_source", "_hash", "_gone", "_digest", "copies", "count", "a", "b", "n")
R = random.Random(11)
VOCABULARY = ["".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(R.randrange(2, 9))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def docs_of(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    for c in CLASH if clash else ():
        df = df.withColumn(c, F.lit(1))
    return df


LONG = prose(60_000, 5)
AWKWARD = [
    (1, "", "a"), (2, "", None), (3, None, "a"), (None, "no id at all", "b"), (None, None, None), (4, "one", "a"), (5, "one", "b"), (6, "one", "a"), (6, "one", "a"),
    (7, "...!!!", "a"), (8, LONG, "c"), (9, LONG, "c"), (10, prose(80, 1), "a"), (11, prose(80, 1).upper() + "!", "b"), (12, "é 日本語 \u0000 \n", "a"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs_of(spark, AWKWARD, clash=True)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(1, 40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect() if r["doc_id"] is not None)


# -- words --------------------------------------------------------------------


def test_words():
    texts = ["Hello, wörld x", "", "hello", "a-b"]
    w = Words(strings(pa.array([*texts, None])))
    assert np.diff(w.first).tolist() == [3, 0, 1, 2, 0]
    assert w.h[0] == w.h[3] and len(set(w.h.tolist())) == 5
    joined = Words(strings(pa.array(["ab", "cd"])))
    assert len(joined.h) == 2 and joined.grams(2)[0].size == 0


# -- 1 ------------------------------------------------------------------------


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) if r.random() < share else w for w in text.split())


def grams(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())


def test_near_dedup_recall_and_precision(spark):
    rows, n = [], 0
    for base in range(60):
        text = prose(150, 100 + base)
        for k in range(1 + base % 4):
            rows.append((n, edited(text, 0.02 * (k + base % 3), n) if k else text, "a"))
            n += 1
    rows += [(n + k, edited(prose(150, 999), 0.01, k), "a") for k in range(60)]  # a large group
    sets = {i: grams(t) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(sets, 2):
        if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= near_dedup.THRESHOLD:
            parent[max(root(x), root(y))] = min(root(x), root(y))
    want = {(i, root(i)) for i in sets if root(i) != i}
    got = {(r["doc_id"], r["duplicate_of"]) for r in near_dedup.near_copies(docs_of(spark, rows)).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.95 * len(want)


def test_near_dedup_sketch():
    a, b = (set(range(0, 2000)), set(range(500, 2500)))
    texts = [" ".join(f"w{x}" for x in sorted(s)) for s in (a, b, a | b)]
    regs = np.concatenate([r for _, _, r in near_dedup.sketches(pa.array(texts))])
    assert abs(near_dedup.cardinality(regs) / np.array([1998, 1998, 2498]) - 1).max() < 0.35
    exact = len(grams(texts[0]) & grams(texts[1])) / len(grams(texts[0]) | grams(texts[1]))
    e = (regs[0] == regs[1]).sum()
    g = (regs[0] > regs[1]).sum()
    size = near_dedup.cardinality(regs)
    est = near_dedup.likeliest(*(np.array([x], float) for x in (g, 128 - e - g, e, size[0], size[1])))[0]
    assert abs(est - exact) < 0.15
    assert (near_dedup.merge(regs[0], regs[1]) <= regs[2]).all()


def test_near_dedup_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = [(k, edited(prose(200, 7), 0.01, k), "a") for k in range(30)]
    got = {(r["doc_id"], r["duplicate_of"], r["group_size"]) for r in near_dedup.near_copies(docs_of(spark, rows)).collect()}
    assert got == {(k, 0, 30) for k in range(1, 30)}


@pytest.mark.parametrize("block", [2048, 100])
def test_near_dedup_boilerplate(spark, monkeypatch, block):
    """Pairs just above the threshold among many documents that share boilerplate just below it."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    boilerplate = prose(205, 77)
    rows = [(k, f"{boilerplate} {prose(15, 60_000 + k // 2)} {prose(100, 61_000 + k)}", "a") for k in range(240)]
    sets = {i: grams(t) for i, t, _ in rows}
    near = {(y, x) for x, y in itertools.combinations(sets, 2) if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= near_dedup.THRESHOLD}
    assert near == {(k + 1, k) for k in range(0, 240, 2)}
    got = {(r["doc_id"], r["duplicate_of"]) for r in near_dedup.near_copies(docs_of(spark, rows)).collect()}
    assert got <= near and len(got) >= 0.9 * len(near)


def test_near_dedup_awkward(spark, awkward, empty):
    assert {(r["doc_id"], r["duplicate_of"]) for r in near_dedup.near_copies(awkward).collect()} == {(5, 4), (6, 4), (9, 8), (11, 10)}
    kept = near_dedup.near_dedup(awkward)
    assert kept.columns == awkward.columns and ids(kept) == [1, 2, 3, 4, 7, 8, 10, 12] and kept.count() == 10
    assert near_dedup.near_copies(empty).count() == 0 and near_dedup.near_dedup(empty).count() == 0


# -- 2 ------------------------------------------------------------------------


def test_chat_spans():
    for seed in range(60):
        r = random.Random(seed)
        counts = [r.randrange(1, 60) for _ in range(r.randrange(0, 30))]
        room = r.choice([40, 80, 200])
        got = list(chat.spans(counts, room, history=3, share=0.5))
        assert [k for s in got for k in range(s.new, s.end)] == list(range(len(counts)))
        for s in got:
            total = sum(counts[s.history : s.end])
            assert s.over == (total > room) and (not s.over or s.end - s.history == 1)
            assert s.new - s.history <= 3
            if not s.over and s.end < len(counts):
                assert total + counts[s.end] > room  # as many as fit
            if s.history > 0 and not s.over and s.new - s.history < 3:
                more = sum(counts[s.history - 1 : s.new])
                assert more > 0.5 * room or more + counts[s.new] > room


def test_chat_windows(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", prose(40, k)) for k in range(1, 30)]
    turns += [(2, 0, "assistant", None), (2, 0, "assistant", None), (3, 1, None, prose(3000, 3)), (None, 1, "user", "x"), (4, None, "user", "x"), (5, 0, "system", "only")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n_tokens", F.lit(1))
    rows = sorted(chat.chat_windows(df, budget=600).collect(), key=lambda r: (r["conv_id"], r["window"]))
    _, decode = chat.tokenizer(chat.TOKENIZER)
    for r in rows:
        assert decode(r["input_ids"]) == r["text"]
        assert len(r["input_ids"]) == len(r["loss_mask"]) == r["n_tokens"] and sum(r["loss_mask"]) == r["n_targets"]
        assert r["over_budget"] == (r["n_tokens"] > 600)
    one = [r for r in rows if r["conv_id"] == 1]
    assert len(one) > 2 and all(r["text"].startswith("<|im_start|>system\nbe kind") for r in one)
    learned = [decode([t for t, m in zip(r["input_ids"], r["loss_mask"]) if m]) for r in one]
    assert "".join(learned) == "".join(f"{t}<|im_end|>\n" for _, _, role, t in turns[:30] if role == "assistant")
    assert [r["over_budget"] for r in rows if r["conv_id"] == 3] == [True]
    assert {r["conv_id"] for r in rows} == {1, 2, 3, 5}
    assert chat.chat_windows(df.limit(0)).count() == 0


def brute_windows(turns, budget, history=chat.HISTORY, share=chat.HISTORY_SHARE):
    """Windows by trying all beginnings and ends, each turn tokenized by itself."""
    encode, _ = chat.tokenizer("/opt/tokenizers/byte_bpe_50k.json")
    lead = next((k for k, t in enumerate(turns) if t[1] != "system"), len(turns))
    parts = [(encode([f"<|im_start|>{r}\n"])[0], encode([f"{x}<|im_end|>\n"])[0]) for _, r, x in turns]
    size = lambda a, b: sum(len(h) + len(t) for h, t in parts[a:b])
    room = max(0, budget - size(0, lead))
    out, i = [], lead
    while i < len(turns) or not out:
        if i < len(turns) and size(i, i + 1) > room:
            first, end = i, i + 1
        else:
            first = min(h for h in range(max(lead, i - history), i + 1) if h == i or all(size(k, i) <= share * room and size(k, i + 1) <= room for k in range(h, i)))
            end = max(e for e in range(i, len(turns) + 1) if size(first, e) <= room) if i < len(turns) else i
        shown = [*range(lead), *range(first, end)]
        ids = [t for k in shown for t in parts[k][0] + parts[k][1]]
        mask = [m for k in shown for m in [0] * len(parts[k][0]) + [int(k >= i and k >= lead and turns[k][1] == "assistant")] * len(parts[k][1])]
        out.append((len(out), ids, mask, i - first))
        i = end
    return out


def test_chat_is_brute_force(spark):
    r = random.Random(12)
    rows = []
    for conv in range(25):
        for turn in range(r.randrange(1, 25)):
            role = "system" if turn == 0 and conv % 3 == 0 else r.choice(["user", "assistant", "system", "tool"])
            rows.append((conv, turn // r.choice([1, 1, 2]), role, prose(r.choice([0, 1, 10, 40, 200]), r.randrange(10**6)) + r.choice(["", "é日本", "<|im_end|>", "\n\n"])))
    rows += [rows[5], rows[5], (90, 0, "system", prose(900, 1)), (90, 1, "user", "x"), (91, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("window", "input_ids", "n_tokens", "key", "text_a"):
        df = df.withColumn(c, F.lit(1))
    got = sorted((x["conv_id"], x["window"], x["input_ids"], x["loss_mask"], x["history_turns"]) for x in chat.chat_windows(df.repartition(3), budget=300).collect())
    want = []
    for conv in sorted({x[0] for x in rows}):
        turns = sorted(x[1:] for x in rows if x[0] == conv)
        want += [(conv, *w) for w in brute_windows(turns, 300)]
    assert got == want and len(want) > 60


# -- 3 ------------------------------------------------------------------------


def test_mixing(spark):
    rows = [(k, f"t{k}", "hot" if k % 2 else f"s{k % 10}") for k in range(2000)]
    df = docs_of(spark, rows)
    got = mixing.mix(df, {"hot": 2, "s0": 1, "s2": 1, "none": 5}, shard_docs=100).collect()
    by = {s: sum(r["source"] == s for r in got) for s in ("hot", "s0", "s2")}
    assert by == {"hot": 400, "s0": 200, "s2": 200} and len({r["doc_id"] for r in got}) == len(got)
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    assert sorted(shards) == list(range(8))
    for members in shards.values():
        assert sorted(r["position"] for r in members) == list(range(1, len(members) + 1)) and abs(len(members) - 100) <= 32
        assert len({r["source"] for r in sorted(members, key=lambda r: r["position"])[:30]}) > 1
    again = mixing.mix(df.repartition(7), {"hot": 2, "s0": 1, "s2": 1}, shard_docs=100)
    assert {(r["doc_id"], r["shard"], r["position"]) for r in again.collect()} == {(r["doc_id"], r["shard"], r["position"]) for r in got}


def test_mixing_tree():
    blocks = np.array([1000, 50, 3, 0])


    def dense(shards, seed=mixing.SEED, top=1):
        out = np.zeros((shards, 4), np.int64)
        for lo, hi, i, b in mixing.split(np.arange(4), blocks, 1053, shards, 0, shards, seed, top):
            for k, _, j, c in mixing.split(i, b, 1053, shards, lo, hi, seed):
                out[k, j] = c
        return out

    leaves = dense(7)
    assert all((dense(7, top=t) == leaves).all() for t in (2, 3, 7))
    assert (leaves.sum(0) == blocks).all() and (leaves >= 0).all() and np.ptp(leaves.sum(1)) <= 1
    mean = np.mean([dense(4, seed)[0] for seed in range(400)], 0)
    assert np.abs(mean - blocks / 4).max() < 1.2
    assert mixing.quotas({"a": 10, "b": 3}, {"a": 0.5, "b": 0.5}) == {"a": 3, "b": 3}
    assert mixing.quotas({"a": 10, "b": 10, "c": 10}, mixing.targets({"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1, "c": 1})) == {"a": 10, "b": 10, "c": 10}


def test_mixing_keeps_all_by_default(spark):
    for sizes in ({"hot": 50_000, **{f"s{k}": 2500 for k in range(20)}, mixing.UNKNOWN: 1}, {"hot": 5_000_000_000, "b": 250_000_007, "c": 3}, {"one": 1}):
        assert mixing.quotas(sizes, mixing.targets(sizes)) == sizes
    rows = [(k, f"t{k}", "hot" if k < 900 else "small" if k < 999 else None) for k in range(1000)]
    assert ids(mixing.mix(docs_of(spark, rows))) == list(range(1000))
    got = mixing.mix(docs_of(spark, rows), total=500).collect()
    by = {s: sum(r["source"] == s for r in got) for s in ("hot", "small", None)}
    assert len(got) == 500 and by[None] == 1 and by["small"] == 88 and len({r["doc_id"] for r in got}) == 500


def brute_mix(rows, take, leaves, block, hashes):
    """Shard of each row: its place in the order of its source's hashes, in the blocks of the tree's leaves."""
    out = {}
    for s, n in take.items():
        mine = sorted((hashes[k], k) for k, r in enumerate(rows) if (r[2] or mixing.UNKNOWN) == s)[:n]
        ends = np.cumsum([b.get(s, 0) for b in leaves])
        for place, (_, k) in enumerate(mine):
            out[k] = int(np.searchsorted(ends, place // block, "right"))
    return out


@pytest.mark.parametrize("weights", [None, {"hot": 3, "s1": 1, "s4": 1}])
def test_mixing_is_brute_force(spark, weights):
    r = random.Random(5)
    rows = [(k, f"t{k}", "hot" if k % 3 else r.choice(["s1", "s4", None])) for k in range(900)]
    df = docs_of(spark, rows)
    hashes = {x["doc_id"]: x["h"] for x in df.select("doc_id", mixing._hash(df, mixing.SEED).alias("h")).collect()}
    sizes = {s: sum((x[2] or mixing.UNKNOWN) == s for x in rows) for s in ("hot", "s1", "s4", mixing.UNKNOWN)}
    take = mixing.quotas(sizes, mixing.targets(sizes, weights))
    names, shards = list(take), max(1, round(sum(take.values()) / 50))
    per = np.array([-(-take[s] // 8) for s in names])
    leaves = [{names[j]: int(b) for j, b in zip(i, c)} for _, _, i, c in sorted(mixing.split(np.arange(len(names)), per, int(per.sum()), shards, 0, shards), key=lambda x: x[0])]
    want = brute_mix(rows, take, leaves, 8, hashes)
    got = mixing.mix(df, weights, block=8, shard_docs=50).collect()
    assert {x["doc_id"]: x["shard"] for x in got} == want and len(got) == len(want)
    for k in range(shards):
        mine = [x for x in got if x["shard"] == k]
        assert sorted(x["position"] for x in mine) == list(range(1, len(mine) + 1))


def test_mixing_ties(spark):
    """Rows with one id and text that differ elsewhere, and rows that are equal: the mix doesn't depend on how they are partitioned."""
    df = docs_of(spark, [(1, "same", "a")] * 200 + [(None, None, None)] * 150).withColumn("more", F.when(F.rand(3) < 0.5, F.floor(F.rand(4) * 20))).withColumn("m", F.create_map(F.lit("k"), F.col("more")))
    df = spark.createDataFrame(df.collect(), df.schema)
    key = lambda r: (r["doc_id"], r["more"], r["shard"], r["position"])
    one, other = (sorted(map(key, mixing.mix(x, {"a": 1, mixing.UNKNOWN: 1}, shard_docs=64, total=120).collect()), key=repr) for x in (df, df.repartition(5)))
    assert one == other and len(one) == 120 and sum(r[0] is None for r in one) == 60
    assert mixing.mix(df).count() == 350


def test_mixing_awkward(spark, awkward, empty):
    got = mixing.mix(awkward, temperature=1.0)
    assert got.count() == len(AWKWARD) and set(got.columns) == set(awkward.columns)
    assert mixing.mix(empty).count() == 0 and mixing.mix(awkward, {"none": 1}).count() == 0


# -- 4 ------------------------------------------------------------------------


def test_secrets(spark, awkward, empty):
    r = random.Random(2)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(20)]
    aws = ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(10)]
    hidden = [f'é {prose(30, k)} token = "{h}" {prose(300, k)}' for k, h in enumerate(hexes)] + [f"{prose(20, k)} {a} {prose(9, k)}" for k, a in enumerate(aws)]
    harmless = [f"{prose(30, 9)} sha {hexes[0]}", "password = passwordpasswordpassword", "token = aaaaaaaaaaaaaaaaaaaaaaaa1", "secret = your_api_key_here", prose(500, 1), "password: " + "example-example-example1"]
    df = docs_of(spark, [(k, t, "a") for k, t in enumerate(hidden + harmless)])
    got = secrets.secrets(df).collect()
    assert {(x["doc_id"], x["sha256"]) for x in got} == {(k, hashlib.sha256(s.encode()).hexdigest()) for k, s in enumerate(hexes + aws)}
    assert all(hidden[x["doc_id"]][x["start"] : x["end"]] in hexes + aws for x in got)
    assert secrets.secrets(awkward).count() == 0 and secrets.secrets(empty).count() == 0


# -- 5 ------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    pages = [(k, f"http://x/{k}", "é" * k + "\r\n\r\nWARC/1.1") for k in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for compress in (False, True):
        data = warc.pack(pages, compress)
        parsed = list(warc.parse(data))
        assert [p[3].decode() for p in parsed] == [h for _, _, h in pages] and b"".join(p[4] for p in parsed) == data
        with pytest.raises(ValueError, match="cut off|no record|gzip"):
            list(warc.parse(data[:-9]))
        folder = tmp_path / f"w{compress}"
        folder.mkdir()
        name = f"pages-00000000-00000.warc{'.gz' if compress else ''}"
        (folder / name).write_bytes(data)
        read = warc.read(spark, str(folder))
        made = warc.records(warc.packed(df, compress))
        assert sorted(map(tuple, read.collect())) == sorted(map(tuple, made.collect())) and warc.audit(made, read).count() == 0
        (folder / name).write_bytes(warc.pack([*pages[:7], (7, pages[7][1], "X" * 14 + pages[7][2][7:]), *pages[8:]]))
        assert {r["status"] for r in warc.audit(made, warc.read(spark, str(folder))).collect()} >= {"changed"}


@pytest.mark.parametrize("compress", [False, True])
def test_warc_damage(compress):
    """Whatever bytes are turned, cut or zeroed, all records elsewhere are found where they are."""
    r = random.Random(5)
    pages = [(k, f"http://x/{k}", prose(r.randrange(0, 300), k)) for k in range(40)]
    data = warc.pack(pages, compress)
    whole = list(warc.scan(data))
    assert all(x.problem is None for x in whole)
    for _ in range(60):
        bad = bytearray(data)
        hit = set()
        for _ in range(r.randrange(1, 4)):
            at, n = r.randrange(len(data)), r.choice([1, 1, 50, 3000])
            n = min(n, len(data) - at)
            kind = r.choice("tzr")
            bad[at : at + n] = bytes(x ^ 64 for x in data[at : at + n]) if kind == "t" else bytes(n) if kind == "z" else r.randbytes(n)
            hit |= {k for k, x in enumerate(whole) if x.offset < at + n and at < x.offset + len(x.stored)}
        cut = r.choice([len(data), r.randrange(len(data))])
        hit |= {k for k, x in enumerate(whole) if x.offset + len(x.stored) > cut}
        got = {(x.offset, x.stored): x for x in warc.scan(bytes(bad[:cut]))}
        for k, x in enumerate(whole):
            if k not in hit:
                assert got[x.offset, x.stored].payload == x.payload
        assert sum(len(s) for _, s in got) <= cut


def test_warc_takes_linear_time():
    import time

    took = []
    for n in (1000, 4000):
        data = warc.pack([(k, "http://x", "y" * 2000) for k in range(n)], True)
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            assert sum(1 for _ in warc.scan(data)) == n
            best = min(best, time.perf_counter() - began)
        took.append(best)
    assert took[1] < 6 * took[0]


def test_warc_audit(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 100)
    r = random.Random(4)
    one = [(f"f{k % 7}", k * 30, 30, f"r{k}", f"d{k}") for k in range(400)]
    other = list(one)
    other[5] = (*other[5][:4], "rot")
    other[90] = (*other[90][:2], 29, *other[90][3:])
    del other[200]
    other.append(("g", 0, 5, "new", "n"))
    other.append((None, 1, 1, "x", "y"))
    r.shuffle(other)
    schema = "file string, offset long, length long, record_id string, digest string"
    a, b = spark.createDataFrame(one, schema), spark.createDataFrame(other, schema)
    got = {(x["record_id"], x["status"]) for x in warc.audit(a, b).collect()}
    assert got == {("r5", "changed"), ("r90", "changed"), ("r200", "missing"), ("new", "extra")}
    assert warc.audit(a, a.union(a.limit(3))).count() == 0
    assert warc.audit(a.limit(0), a.limit(0)).count() == 0 and warc.audit(a, a.limit(0)).count() == 400


def test_warc_audit_of_pages(spark, tmp_path):
    """All kinds of damage, against SQL."""
    import duckdb

    r = random.Random(8)
    pages = [(k, f"http://x/{k}" if k % 9 else None, "é" * r.randrange(60)) for k in range(600)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    want = sorted(con.execute(f'SELECT file, "offset", length, record_id, status FROM ({warc.SQL})').fetchall())
    got = warc.audit_pages(spark.read.parquet(str(tmp_path / "pages")))
    assert sorted(map(tuple, got.collect())) == want and {w[-1] for w in want} == {"changed", "missing", "extra"}


def test_warc_audit_of_neighbours(spark):
    """Unreadable neighbours, and holes beside them, each have their own status."""
    whole = warc.pack((k, "u", "x" * 200) for k in range(7))
    at = [r.offset for r in warc.scan(whole)] + [len(whole)]
    bad = bytearray(whole)
    for k in (1, 2, 4, 6):
        bad[at[k] : at[k] + 8] = b"rotten!!"
    for k in (3, 5):
        bad[at[k] : at[k + 1]] = bytes(at[k + 1] - at[k])
    a, b = (warc.records(spark.createDataFrame([("f", bytes(x))], "file string, content binary")) for x in (whole, bad))
    want = [(at[k], at[k + 1] - at[k], f"<urn:page:{k}>", "missing" if k in (3, 5) else "changed") for k in range(1, 7)]
    assert sorted(map(tuple, warc.audit(a, b).select("offset", "length", "record_id", "status").collect())) == want


def test_warc_pages_awkward(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "u", None), (None, "u", "h"), (3, "u", LONG)] + [(7, "u", "v")] * 120, "page_id long, url string, html string")
    for c in ("file", "offset", "number", "content"):
        pages = pages.withColumn(c, F.lit(2))
    got = warc.records(warc.packed(pages)).collect()
    assert len(got) == 124 and len({(r["file"], r["offset"]) for r in got}) == 124 and len({r["file"] for r in got}) == 3
    assert {len(r["payload"]) for r in got} == {0, 1, len(LONG)} and warc.audit_pages(pages.limit(0)).count() == 0
    assert warc.records(spark.createDataFrame([("a", b""), (None, b"x"), ("b", None), ("c", b"junk")], "file string, content binary")).select("file", "problem").collect() == [("c", "no record")]


# -- 6 ------------------------------------------------------------------------


def test_decontamination(spark, awkward, empty):
    items = [(k, prose(25 + k, 500 + k)) for k in range(30)]
    index = decontaminate.Index([i for i, _ in items], [t for _, t in items])
    r = random.Random(3)
    for _ in range(40):  # WAND against all scores
        terms = np.array(sorted(r.sample(range(len(index.terms)), 60)))
        scores = np.zeros(30)
        for t in terms:
            scores[index.items[t]] += index.impacts[t]
        for threshold in (0.05, 0.1, 0.3):
            assert [i for i, _ in index.wand(terms, threshold)] == np.flatnonzero(scores >= threshold).tolist()
            assert [i for lo in range(0, 30, 7) for i, _ in index.wand(terms, threshold, lo, lo + 7)] == np.flatnonzero(scores >= threshold).tolist()
    rows, want = [], set()
    for k in range(120):
        body = prose(r.randrange(0, 600), 3000 + k).split()
        if k % 3 == 0:
            at = r.randrange(len(body) + 1)
            body[at:at] = items[k % 30][1].upper().split()
            want.add((k, k % 30))
        rows.append((k, " ".join(body), "a"))
    bench = spark.createDataFrame([*items, (77, None), (None, "x"), (78, ""), (79, items[0][1])], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs_of(spark, rows), bench).collect()}
    assert got == want | {(d, 79) for d, i in want if i == 0}
    kept = decontaminate.decontaminate(docs_of(spark, rows), bench)
    assert ids(kept) == [k for k in range(120) if k % 3]
    assert decontaminate.contaminated(awkward, bench).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(awkward, bench.limit(0)).count() == 0 and decontaminate.decontaminate(awkward, bench.limit(0)).count() == len(AWKWARD)
    # The question alone is no leak, nor is the answer.
    q = " ".join(items[3][1].split()[:20])
    assert decontaminate.contaminated(docs_of(spark, [(1, q, "a")]), spark.createDataFrame([(1, q, prose(9, 1))], "item_id long, question string, answer string")).count() == 0


def test_decontamination_truncated(spark):
    """Of items without an answer column, a copy of most words is a leak, whichever end is cut off; a few words aren't."""
    items = [(k, prose(40, 500 + k)) for k in range(12)]
    cuts = [slice(0, 30), slice(14, 40), slice(0, 10), slice(32, 40)]
    df = docs_of(spark, [(k, f"{prose(30, k)} {' '.join(items[k][1].split()[cuts[k % 4]])} {prose(30, 90 + k)}", "a") for k in range(12)])
    got = decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == {(k, k) for k in range(12) if k % 4 < 2}


def test_decontamination_scores_do_not_depend_on_shards(spark, monkeypatch):
    """Borderline passages, and one item that is far longer than the others: the same rows and scores however the items are cut."""
    items = [(k, prose(20 + k % 9, 700 + k)) for k in range(30)] + [(30, prose(400, 9))]
    r = random.Random(4)
    rows = []
    for k in range(90):
        w = items[k % 30][1].split()
        rows.append((k, f"{prose(40, k)} {' '.join(x for x in w if r.random() < 0.7)} {prose(300, 50 + k)}", "a"))
    rows.append((99, f"{prose(20_000, 77)} {items[30][1]} {items[2][1]} {prose(5000, 78)}", "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = []
    for size in (4, 1000):
        monkeypatch.setattr(decontaminate, "SHARD_ITEMS", size)
        got.append(sorted((x["doc_id"], x["item_id"], round(x["score"], 9), x["word"]) for x in decontaminate.contaminated(docs_of(spark, rows), bench).collect()))
    assert got[0] == got[1] and {(99, 30), (99, 2)} <= {x[:2] for x in got[0]} and 10 < len(got[0]) < 90


def test_decontamination_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 4)
    items = [(k, prose(25, 500 + k)) for k in range(10)]
    df = docs_of(spark, [(k, prose(50, k) + " " + items[k][1], "a") for k in range(10)])
    got = decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == {(k, k) for k in range(10)}


# -- 7 ------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5000, 60_000])
def test_binary_fuse(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63 - 1, n).view(np.uint64)
    f = exact_dedup.BinaryFuse.build(np.concatenate([keys, keys[: n // 2]]))
    assert f.contains(keys).all()
    others = rng.integers(-(2**63), 2**63 - 1, 100_000).view(np.uint64)
    assert f.contains(others).mean() < 0.001
    assert n < 5000 or len(f.cells) < 1.4 * n


def test_exact_dedup(spark):
    r = random.Random(8)
    rows = [(k, f"text {r.randrange(150)}", "a") for k in range(400)]
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)
    df = docs_of(spark, rows)
    want = {(i, first[t]) for i, t, _ in rows if first[t] != i}
    snapshot, batch = exact_dedup.halves(df)
    for got in (exact_dedup.copies(df), exact_dedup.copies(batch, snapshot)):
        assert {(x["doc_id"], x["duplicate_of"]) for x in got.collect()} == want
    assert ids(exact_dedup.exact_dedup(df)) == sorted(first.values())


def test_exact_dedup_kept_filters(spark, tmp_path):
    """A snapshot's filters are right for batches that come later, whatever the session's number of partitions is by then."""
    old = docs_of(spark, [(k, f"text {k}", "a") for k in range(1000)])
    exact_dedup.Snapshot.of(old, 8).write(str(tmp_path / "kept"))
    kept = exact_dedup.Snapshot.read(old, str(tmp_path / "kept"))
    batch = docs_of(spark, [(5000 + k, f"text {2 * k}", "a") for k in range(1000)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        got = exact_dedup.copies(batch, kept)
        assert {(r["doc_id"], r["duplicate_of"]) for r in got.collect()} == {(5000 + k, 2 * k) for k in range(500)}
        assert exact_dedup.screen(batch.selectExpr("xxhash64(text) AS digest"), kept.filters).count() < 520
        with pytest.raises(ValueError, match="one snapshot"):
            exact_dedup.screen(kept.digests, kept.filters.union(exact_dedup.Snapshot.of(old, 3).filters))
        none = exact_dedup.Snapshot.of(old.limit(0), 4)
        assert exact_dedup.copies(batch, none).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_exact_dedup_one_digest(spark, monkeypatch):
    """Different texts with one digest are told apart by their bytes."""
    df = docs_of(spark, [(1, "x", "a"), (2, "y", "a"), (3, "x", "a"), (4, "y", "a"), (5, "z", "a")])
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    for got in (exact_dedup.copies(df), exact_dedup.copies(df.where("doc_id > 2"), df.where("doc_id < 3"))):
        assert {(r["doc_id"], r["duplicate_of"], r["copies"]) for r in got.collect()} == {(3, 1, 2), (4, 2, 2)}


def test_exact_dedup_awkward(spark, awkward, empty):
    got = {(r["doc_id"], r["duplicate_of"], r["copies"]) for r in exact_dedup.copies(awkward).collect()}
    assert got == {(2, 1, 2), (5, 4, 4), (6, 4, 4), (9, 8, 2)}
    kept = exact_dedup.exact_dedup(awkward)
    assert kept.columns == awkward.columns and ids(kept) == [1, 3, 4, 7, 8, 10, 11, 12] and kept.count() == 10
    twice = docs_of(spark, [(1, "x", "a"), (1, "x", "a"), (1, "y", "a"), (2, "y", "a")])
    assert sorted(r["text"] for r in exact_dedup.exact_dedup(twice).collect()) == ["x", "y"]
    assert exact_dedup.copies(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


# -- 8 ------------------------------------------------------------------------


def brute_repeats(rows, length, within=False):
    seen, starts, count = {}, {}, {}
    for i, t, _ in rows:
        w = re.findall(r"[^\W_]+", t.lower())
        for s in range(len(w) - length + 1):
            seen.setdefault(tuple(w[s : s + length]), set()).add(i)
            count[tuple(w[s : s + length])] = count.get(tuple(w[s : s + length]), 0) + 1
    for i, t, _ in rows:
        w = re.findall(r"[^\W_]+", t.lower())
        for s in range(len(w) - length + 1):
            if len(seen[tuple(w[s : s + length])]) > 1 or (within and count[tuple(w[s : s + length])] > 1):
                starts.setdefault(i, []).append(s)
    out = set()
    for i, ss in starts.items():
        begin = last = ss[0]
        for s in ss[1:]:
            if s > last + length:
                out.add((i, begin, last + length))
                begin = s
            last = s
        out.add((i, begin, last + length))
    return out


@pytest.mark.parametrize("length,span", [(50, 11), (20, 5), (12, 1)])
def test_suffix_dedup(spark, length, span):
    r = random.Random(length)
    passages = [prose(r.choice([length - 1, length, length + 1, 2 * length, 4 * length]), 40 + k) for k in range(12)]
    rows = []
    for k in range(60):
        parts = [prose(r.randrange(0, 90), 7000 + k)]
        for _ in range(r.randrange(3)):
            parts += [r.choice(passages), prose(r.randrange(0, 9), r.randrange(10**6))]
        rows.append((k, " ".join(parts), "a"))
    rows += [(100, "la " * 200, "a"), (101, rows[0][1] + " tail", "a"), (102, rows[0][1], "a"), (103, "la la " * 99, "a"), (104, prose(30, 1) * 9, "a")]
    got = {(x["doc_id"], x["start_word"], x["end_word"]) for x in suffix_dedup.repeats(docs_of(spark, rows), length, span).collect()}
    assert got == brute_repeats(rows, length) and got
    if span == 5:
        got = {(x["doc_id"], x["start_word"], x["end_word"]) for x in suffix_dedup.repeats(docs_of(spark, rows), length, span, within=True).collect()}
        assert got == brute_repeats(rows, length, True) and got != brute_repeats(rows, length)


def test_suffix_hot_line(spark):
    """A line that all documents have, in different contexts."""
    line = prose(70, 4321)
    rows = [(k, f"{prose(k % 30, 8000 + k)} {line} {prose(k % 17, 9000 + k)}", "a") for k in range(400)]
    got = {(x["doc_id"], x["start_word"], x["end_word"]) for x in suffix_dedup.repeats(docs_of(spark, rows, clash=True)).collect()}
    assert got == brute_repeats(rows, 50) and len(got) == 400


def test_suffix_merge():
    r = random.Random(1)
    for _ in range(50):
        runs, every = [], []
        for _ in range(r.randrange(0, 7)):
            run = sorted(tuple(r.randrange(3) for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(0, 9)))
            lcp = [0] + [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in itertools.pairwise(run)]
            runs.append((run, lcp[: len(run)]))
            every += run
        out = list(suffix_dedup.merge(runs))
        got = [runs[k][0][i] for k, i, _ in out]
        assert got == sorted(every)
        for (_, _, n), a, b in zip(out[1:], got, got[1:]):
            assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])


def test_suffix_front_coding():
    rng = np.random.default_rng(0)
    n, w = 300, 4
    after = rng.integers(1, 3, (n, w)).astype(np.uint32)
    for k in range(n):
        after[k, rng.integers(1, w + 1) :] = 0
    run = suffix_dedup.Run(rng.integers(0, 5, n).astype(np.uint64), after, rng.integers(0, 9, (n, w)).astype(np.uint32), rng.integers(0, 99, n), rng.integers(0, 99, n).astype(np.int32)).sort()
    back, lcp = suffix_dedup.Run.decode(run.encode())
    for f in ("first", "after", "before", "doc", "pos"):
        assert (getattr(run, f) == getattr(back, f)).all()
    assert (lcp == run.common()).all()


def test_suffix_awkward(awkward, empty):
    got = {(x["doc_id"], x["start_word"], x["end_word"]) for x in suffix_dedup.repeats(awkward).collect()}
    assert got == {(8, 0, 60_000), (9, 0, 60_000), (10, 0, 80), (11, 0, 80)}
    assert suffix_dedup.repeats(empty).count() == 0


# -- 9 ------------------------------------------------------------------------

VALUES = ["4539 1488 0343 6467", "4539148803436467", "378282246310005", "8.8.4.4", "+1 (415) 555-2671", "415-555-2671", "078-05-1120", "2021-03-04", "31/12/1999", "12/31/1999", "24.12.2001", "DE89 3704 0044 0532 0130 00", "Ann.Lee_7@mail.example-one.com"]


@pytest.mark.parametrize("value", VALUES)
def test_pii_forms(value):
    text = f"é before {value}, after {value}."
    new, n = pii.pseudonymize(text)
    assert n == 2 and value not in new
    fresh = re.fullmatch(r"é before (.+), after (.+)\.", new)
    assert fresh[1] == fresh[2] and len(fresh[1]) == len(value) or value == "8.8.4.4"
    assert pii.pseudonymize(new, back=True)[0] == text
    assert pii.pseudonymize(text, b"other")[0] != new
    digits = "".join(c for c in fresh[1] if c.isdigit())
    if value[0] in "43" and len(digits) in (15, 16) and "-" not in value:
        assert pii.luhn(digits) == pii.luhn("".join(c for c in value if c.isdigit()))


@pytest.mark.parametrize(
    "value",
    ["+44 20 7946 0958", "+49 30 901820", "+34 912 345 678", "+33 1 42 68 53 00", "+44 (20) 7946 0958", "3782 822463 10005", "3782-822463-10005", "3.5.1971", "13.5.1971", "1/2/2020", "13/2/2020", "2020-1-2", "+49 301 23 4567"],
)
def test_pii_more_forms(value):
    text = f"é before {value}, after {value}."
    new, n = pii.pseudonymize(text)
    fresh = re.fullmatch(r"é before (.+), after (.+)\.", new)
    assert n == 2 and value not in new and fresh[1] == fresh[2]
    assert re.sub(r"\d", "0", fresh[1]) == re.sub(r"\d", "0", value)
    assert pii.pseudonymize(new, back=True)[0] == text


def test_pii_neighbours():
    for text, count, kept in (
        ("from 2020-01-02/2020-02-03 on", 2, ("2020-01-02", "2020-02-03")),
        ("to GB29 NWBK 6016 1331 9268 19 BIC NWBKGB2L", 1, ("6016 1331",)),
        ("DE89 3704 0044 0532 0130 00 GB29 NWBK 6016 1331 9268 19 OK", 2, ("3704 0044", "6016 1331")),
        ("call +49 30 901820 2021-03-04", 2, ("901820", "2021-03-04")),
    ):
        new, n = pii.pseudonymize(text)
        assert n == count and not any(x in new for x in kept)
        assert pii.pseudonymize(new, back=True)[0] == text


def test_pii_links_spellings():
    new = lambda x: pii.pseudonymize(x)[0]
    for day, month, year in ((4, 3, 2021), (25, 12, 1999), (11, 10, 1850), (9, 11, 2400), (31, 1, 999)):
        forms = [f"{year:04d}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year:04d}", f"{month:02d}/{day:02d}/{year:04d}", f"{year:04d}/{month}/{day}", f"{day}.{month}.{year:04d}"]
        got = [re.split(r"[-./]", new(f"on {x} it")[3:-3]) for x in forms]
        order = ["ymd", "dmy", "mdy", "ymd", "dmy"]
        assert len({tuple(int(dict(zip(o, g))[x]) for x in "ymd") for o, g in zip(order, got)}) == 1
        assert int(dict(zip(order[0], got[0]))["y"]) // 100 == year // 100
        assert all(new(x) != x and pii.pseudonymize(new(x), back=True)[0] == x for x in forms)
    phones = [new(x) for x in ("+1 415-555-2671", "415-555-2671", "(415) 555-2671", "+14155552671", "415.555.2671")]
    assert len({re.sub(r"\D", "", x)[-10:] for x in phones}) == 1
    assert re.sub(r"\D", "", new("+44 20 7946 0958")) == re.sub(r"\D", "", new("+442079460958"))


def test_pii_dates_permute():
    """All dates of a century go to different ones of it, which go back."""
    import datetime

    first = datetime.date(1900, 1, 1).toordinal()
    every = [datetime.date.fromordinal(first + k).isoformat() for k in range(0, 36524)]
    new = [pii.date(x, b"k") for x in every]
    assert sorted(new) == every and [pii.date(x, b"k", True) for x in new[:500]] == every[:500]


def test_pii_permutation():
    for size in (1, 2, 10, 365, 1000):
        out = [pii.permute(k, size, b"k", "t") for k in range(size)]
        assert sorted(out) == list(range(size)) and [pii.permute(x, size, b"k", "t", True) for x in out] == list(range(size))
    assert pii.permute(0, 10**200, b"k", "t") != 0


def test_pii_leaves_the_rest(spark, awkward, empty):
    for text in ("version 1.2.3 of 2021", "999.1.1.1", "2021-13-45", "12345", "a@b", "no @ all", "3.14159265358979", "1,000,000 and 10:30", "4785380592391130", '"ts": 1700000000000', '"id": 9007199254740993', "٢٠٢١-٠٣-٠٤ and ٤٥٣٩١٤٨٨٠٣٤٣٦٤٦٧"):
        assert pii.pseudonymize(text) == (text, 0)
    got = pii.pseudonyms(awkward)
    assert set(got.columns) == set(awkward.columns) and got.count() == len(AWKWARD)
    assert {(r["doc_id"], r["text"], r["replaced"]) for r in got.collect()} == {(i, t, 0) for i, t, _ in AWKWARD}
    assert pii.pseudonyms(empty).count() == 0
    linked = pii.pseudonyms(docs_of(spark, [(1, "mail ann@x.com", "a"), (2, "to ann@x.com!", "a")])).collect()
    assert {re.search(r"\S+@\w+\.com", r["text"]).group() for r in linked}.__len__() == 1


# -- 10 -----------------------------------------------------------------------


def test_toxicity_learns_pairs():
    """Neither word tells, only both together do: linear weights can't, the machine can."""
    r = np.random.default_rng(0)
    noise = [r.choice(np.arange(100, 200), 5, replace=False) for _ in range(2000)]
    rows, labels = [], []
    for k, n in enumerate(noise):
        insult, group = k % 2, (k // 2) % 2
        rows.append(np.array(sorted([*n, *[1] * insult, *[2] * group])))
        labels.append(insult & group)
    m = toxicity.fit(rows, np.array(labels), bits=8, least=2, epochs=60)
    s = lambda t: m._score(1, np.zeros(len(t), int), m.slot[np.array(t)])[0]
    assert s([1, 2]) > 0 > max(s([1]), s([2]))


def test_toxicity_held_out(spark, labels):
    r = random.Random(6)
    bad = ["grumblefool", "snarkwit", "dolterel"]
    rows = []
    for k in range(1200):
        words = prose(r.randrange(20, 200), 50_000 + k).split()
        if k % 4 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((k, " ".join(words), "a"))
    df = docs_of(spark, rows)
    known = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    got = set(ids(toxicity.toxic(df, known)))
    held = range(600, 1200)
    assert sum(k in got for k in held if k % 4 == 0) >= 148 and sum(k in got for k in held if k % 4) <= 4
    assert toxicity.toxic(df, known, most=300).count() > 200


def test_toxicity_awkward(awkward, empty, labels):
    assert toxicity.toxic(awkward, labels.limit(0)).count() == 0
    assert toxicity.clean(awkward, labels).columns == awkward.columns
    assert {r["doc_id"] for r in toxicity.toxic(awkward, labels).collect()} <= set(range(1, 13))
    assert toxicity.toxic(empty, labels).count() == 0


