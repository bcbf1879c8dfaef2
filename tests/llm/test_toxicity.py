"""The factorization machine: pairs of words that tell nothing alone, and its closed form."""

import itertools

import numpy as np
import pytest
from test_operators import DOCS, prose

from tidemark.llm import toxicity


def score(m, terms):
    s = m.slot[np.array(terms)]
    s = s[s >= 0]
    return float(m._score(1, np.zeros(len(s), int), s)[0])


@pytest.mark.parametrize("noise", [5, 40])
@pytest.mark.parametrize("law", ["xor", "and"])
def test_pairs_without_single_effect(noise, law):
    r = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(4000):
        a, b = k % 2, (k // 2) % 2
        rows.append(np.array(sorted([*r.choice(np.arange(100, 1000), noise, replace=False), *[1] * a, *[2] * b])))
        labels.append(a ^ b if law == "xor" else a & b)
    m = toxicity.fit(rows[:3000], np.array(labels[:3000]), bits=12)
    assert [score(m, x) > 0 for x in rows[3000:]] == [bool(y) for y in labels[3000:]]


def test_insult_with_group():
    """Insults and group names that are as frequent in clean documents; only an insult with a group name is toxic."""
    r = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(8000):
        insult, group, u = r.integers(1, 5), r.integers(11, 15), r.random()
        own = [insult, group] if u < 0.1 else [insult] if u < 0.2 else [group] if u < 0.3 else []
        rows.append(np.unique([*r.choice(np.arange(100, 3000), 60, replace=False), *own]))
        labels.append(u < 0.1)
    labels = np.array(labels)
    m = toxicity.fit(rows[:6000], labels[:6000], bits=12)
    got = np.array([score(m, x) for x in rows[6000:]]) > 0
    assert got[labels[6000:]].mean() > 0.98 and got[~labels[6000:]].mean() < 0.01


def test_closed_form_is_the_sum_over_pairs():
    r = np.random.default_rng(2)
    m = toxicity.Machine(4, 0.3, np.arange(16, dtype=np.int32), r.normal(size=16), r.normal(size=(16, 3)))
    for _ in range(20):
        t = r.choice(16, 6, replace=False)
        pairs = sum(float(m.v[a] @ m.v[b]) for a, b in itertools.combinations(t, 2))
        assert abs(score(m, t) - (0.3 + m.w[t].sum() + pairs)) < 1e-9


def test_noise_keeps_no_term():
    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 400, 40)) for _ in range(2000)]
    m = toxicity.fit(rows, r.random(2000) < 0.1, bits=10)
    assert (m.slot >= 0).sum() <= 2


def test_shared_ids_and_one_class(spark):
    rows = [(k, prose(30, k) + (" grumblefool" if k % 2 else ""), "en", "a", 1) for k in range(200)]
    rows += [(500, prose(30, 1), "en", "a", 1), (500, "grumblefool " + prose(9, 3), "en", "a", 1), (None, "grumblefool", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(100)], "doc_id long, quality int, toxic int")
    kept = toxicity.clean(docs, labels).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == list(range(0, 200, 2))
    assert sum(r["doc_id"] is None for r in kept) == 1
    assert toxicity.toxic(docs, labels.where("toxic = 0")).count() == 0 and toxicity.toxic(docs, labels.where("toxic = 1")).count() == 0
