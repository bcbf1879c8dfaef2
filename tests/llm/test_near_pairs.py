"""Near-dedup against brute force with equality: every pair that meets in a band and is estimated near enough is verified."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from test_operators import docs_of, edited, prose

from tidemark.llm import near_dedup as N


def brute(rows):
    """Groups of the pairs that meet in a band and whose whole texts are near, all pairs being tried."""
    ids = [i for i, _, _ in rows]
    texts = pa.array([t for _, t, _ in rows])
    regs = np.concatenate([r for _, _, r in N.sketches(texts)])
    keys = pa.Table.from_batches(N._bands([pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "regs"])])).to_pydict()
    buckets = {}
    for i, k in zip(keys["doc_id"], keys["key"]):
        buckets.setdefault(k, set()).add(i)
    meet = {p for b in buckets.values() for p in itertools.combinations(sorted(b), 2)}
    at = {i: k for k, i in enumerate(ids)}
    x, y = (np.array([at[p[s]] for p in meet], int) for s in (0, 1))
    equal, greater = (regs[x] == regs[y]).sum(1), (regs[x] > regs[y]).sum(1)
    size = N.cardinality(regs)
    near = N.likeliest(greater, regs.shape[1] - equal - greater, equal, size[x], size[y]) >= N.THRESHOLD - N.SLACK
    sets = N._sets(texts)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), ok in zip(meet, near.tolist()):
        if (ok or (regs[at[a]] == regs[at[b]]).all()) and N._jaccard(sets[at[a]], sets[at[b]]) >= N.THRESHOLD:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {(i, root(i)) for i in ids if root(i) != i}


@pytest.fixture(scope="module")
def corpus():
    """Groups near the threshold, where forests of estimates have edges that fail, and one bucket of many."""
    rows = [(8 * g + k, edited(prose(120, 300 + g), 0.03 + 0.012 * k, 9000 + 8 * g + k), "a") for g in range(60) for k in range(8)]
    rows += [(1000 + k, edited(prose(150, 999), 0.004 * (k % 30), k), "a") for k in range(150)]
    return rows, brute(rows)


@pytest.mark.parametrize("block", [4, 2048])
def test_all_pairs_that_meet_are_verified(spark, monkeypatch, corpus, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows, want = corpus
    got = {(r["doc_id"], r["duplicate_of"]) for r in N.near_copies(docs_of(spark, rows, clash=True)).collect()}
    assert got == want and len(want) > 200


def test_shared_ids(spark):
    """Rows that share a doc_id are one document, near another if one of its texts is."""
    rows = [(1, prose(90, 1), "a"), (2, prose(90, 2), "a"), (2, edited(prose(90, 1), 0.02, 5), "a"), (3, prose(90, 3), "a"), (3, prose(90, 3), "a")]
    assert {(r["doc_id"], r["duplicate_of"]) for r in N.near_copies(docs_of(spark, rows)).collect()} == {(2, 1)}
