"""Toxicity (10): a factorization machine over hashed terms.

score = w0 + sum of w[t] over the document's terms
      + sum over pairs of terms of <v[t], v[u]>
The pair part is computed as half of |sum v|^2 - sum |v|^2, in time linear in
the terms.  It learns pairs, such as an insult beside a mention of a group, that
no sum of single weights can tell from either word alone.

The machine is fitted in numpy on a bounded sample of the labelled documents
(SAMPLE) and its weights, whose size is fixed by BITS and FACTORS, go to the
executors, where whole Arrow batches of whole texts are scored at once.

A term takes part if its own share of toxic documents differs from chance, or if
its share together with some other term does from what the machine of the single
terms expects there: two words that are harmless alone are kept for their pair.
Terms that tell nothing either way would only add noise to long texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, narrow, ready, settle, without
from .words import pieces

#: Most labelled documents that the machine is fitted on, chosen by a hash of their ids.
SAMPLE = 20_000
#: Hashed terms and factors of each; terms seen in fewer than LEAST sampled documents have no weight.
BITS, FACTORS, LEAST = 20, 4, 4
#: Least evidence, in nats of likelihood, that a pair of terms tells more than the two by themselves; e**-24 is chance for each of some 10**8 pairs.
EVIDENCE = 24.0
#: Most pairs of terms looked at in the fit; the shortest documents of the sample come first.
PAIRS = 200_000_000
#: Bytes of a stem, and of the least word that has one.
STEM = (4, 6)
#: Least probability, with both classes weighing the same, of a document that is reported.
THRESHOLD = 0.3


def _terms(texts: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Distinct hashed terms by document: rows i..j, then the row and the term of each.

    Terms are words and, for longer words, stems, which inflected forms share.
    """
    for i, j, w in pieces(texts):
        if not len(w.h):
            yield i, j, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        stems = w.stems(*STEM)
        long = stems != 0
        row = np.concatenate([w.row, w.row[long]]).astype(np.int64)
        key = np.unique((row << bits) | (np.concatenate([w.h, stems[long]]) >> np.uint64(64 - bits)).astype(np.int64))
        yield i, j, key >> bits, key & ((1 << bits) - 1)


class Machine:
    """A fitted factorization machine; w and v have rows only for the terms kept."""

    def __init__(self, bits: int, w0: float, slot: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bits, self.w0, self.slot, self.w, self.v = bits, w0, slot, w, v

    def _score(self, n: int, row: np.ndarray, s: np.ndarray) -> np.ndarray:
        out = np.full(n, self.w0)
        if len(row):
            out += np.bincount(row, self.w[s], n)
            for f in range(self.v.shape[1]):
                x = self.v[s, f]
                out += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of toxicity of each text; an empty text has that of no evidence."""
        out = np.empty(len(texts))
        for i, j, row, term in _terms(texts, self.bits):
            s = self.slot[term]
            known = s >= 0
            out[i:j] = self._score(j - i, row[known], s[known])
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _divergence(seen: np.ndarray, expected: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n times the Kullback-Leibler divergence of the shares seen/n and expected/n: Chernoff's bound on chance, as nats."""
    q, p = seen / n, np.clip(expected / n, 1e-9, 1 - 1e-9)
    tiny = 1e-12
    return n * (q * np.log((q + tiny) / p) + (1 - q) * np.log((1 - q + tiny) / (1 - p)))


def telling_pairs(start: np.ndarray, term: np.ndarray, labels: np.ndarray, expected: np.ndarray, size: int, least: int, evidence: float = EVIDENCE, most: int = PAIRS) -> np.ndarray:
    """Terms whose toxic share together with another term differs from the expected one; start has where each document's terms begin."""
    length = np.diff(start)
    order = np.argsort(length, kind="stable")
    taken = np.zeros(len(length), bool)
    taken[order[np.cumsum(length[order].astype(np.int64) ** 2) <= most]] = True
    chosen = np.flatnonzero(taken)
    terms = term[np.repeat(taken, length)]
    if not len(terms):
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(chosen), dtype=np.int32), length[chosen])
    df = np.bincount(terms, minlength=size)
    # A pair needs this many documents to reach the evidence at all.
    names = np.flatnonzero(df >= max(least, 8))
    number = np.full(size, -1, np.int32)
    number[names] = np.arange(len(names))
    own = number[terms]
    del terms
    known = own >= 0
    doc, own = doc[known], own[known]
    begin = np.searchsorted(doc, np.arange(len(chosen) + 1))
    # The documents of each term, one term's after another's.
    cut = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(names)))])
    by_term = doc[np.argsort(own, kind="stable")]
    y, p = labels[chosen], expected[chosen]
    hit = np.zeros(len(names), bool)
    for t in range(len(names)):
        d = by_term[cut[t] : cut[t + 1]]
        count = begin[d + 1] - begin[d]
        at = np.repeat(begin[d] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        other = own[at]
        n = np.bincount(other, minlength=len(names))
        seen = np.bincount(other, np.repeat(y[d], count), len(names))
        mean = np.bincount(other, np.repeat(p[d], count), len(names))
        can = np.flatnonzero(n >= max(least, 8))
        can = can[can != t]
        good = can[_divergence(seen[can], mean[can], n[can]) >= evidence]
        # A pair of terms that only occur together tells what each of them does.
        good = good[(n[good] < df[names[t]]) | (n[good] < df[names[good]])]
        if len(good):
            hit[t] = True
            hit[good] = True
    return names[hit]


def _descend(kept: np.ndarray, term: np.ndarray, doc: np.ndarray, labels: np.ndarray, bits: int, factors: int, epochs: int, rate: float, l2: float, seed: int) -> Machine:
    """AdaGrad over the terms kept."""
    slot = np.full(1 << bits, -1, np.int32)
    slot[kept] = np.arange(len(kept))
    s = slot[term]
    ok = s >= 0
    s, doc = s[ok], doc[ok]
    rng = np.random.default_rng(seed)
    n, k, positive = len(labels), len(kept), labels.sum()
    m = Machine(bits, 0.0, slot, np.zeros(k), rng.normal(0, 0.1, (k, factors)))
    weight = np.where(labels > 0, 0.5 / positive, 0.5 / (n - positive)) * n
    order_start = np.searchsorted(doc, np.arange(n + 1))
    g0, gw, gv = 1e-8, np.full(k, 1e-8), np.full((k, factors), 1e-8)
    batch = max(64, n // 40)
    for _ in range(epochs):
        perm = rng.permutation(n)
        for b in range(0, n, batch):
            take = perm[b : b + batch]
            count = order_start[take + 1] - order_start[take]
            row = np.repeat(np.arange(len(take)), count)
            at = np.repeat(order_start[take] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            ss = s[at]
            sums = np.stack([np.bincount(row, m.v[ss, f], len(take)) for f in range(factors)], 1)
            out = m._score(len(take), row, ss)
            err = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - labels[take]) * weight[take] / len(take)
            d0 = err.sum()
            dw = np.bincount(ss, err[row], k) + l2 * m.w
            dv = np.stack([np.bincount(ss, err[row] * (sums[row, f] - m.v[ss, f]), k) for f in range(factors)], 1) + l2 * m.v
            g0 += d0 * d0
            gw += dw * dw
            gv += dv * dv
            m.w0 -= rate * d0 / np.sqrt(g0)
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= 0.3 * rate * dv / np.sqrt(gv)
    return m


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, least: int = LEAST, epochs: int = 40, rate: float = 0.1, l2: float = 2e-4, seed: int = 7) -> Machine:
    """A machine on the logistic loss, both classes weighing the same; rows has the hashed terms of each document.

    Without labelled rows of both classes there is nothing to learn: everything is then clean.
    """
    size = 1 << bits
    labels = np.asarray(labels, float)
    constant = Machine(bits, -4.0, np.full(size, -1, np.int32), np.zeros(1), np.zeros((1, factors)))
    positive = labels.sum()
    if not 0 < positive < len(labels):
        return constant
    length = np.array([len(r) for r in rows])
    term = np.concatenate(rows).astype(np.int32) if length.sum() else np.zeros(0, np.int32)
    start = np.concatenate([[0], np.cumsum(length)])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), length)
    df = np.bincount(term, minlength=size)
    df1 = np.bincount(term, labels[doc], minlength=size)
    p = positive / len(labels)
    z = (df1 - df * p) / np.sqrt(np.maximum(df, 1) * p * (1 - p))
    single = np.flatnonzero((df >= least) & (np.abs(z) >= 4))
    m = _descend(single, term, doc, labels, bits, factors, epochs, rate, l2, seed) if len(single) else constant
    # What the single terms expect of each document, at the sample's own share of toxic ones.
    if len(single):
        s = m.slot[term]
        out = m._score(len(rows), doc[s >= 0], s[s >= 0])
        lo, hi = -60.0, 60.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (1 / (1 + np.exp(-np.clip(out + mid, -40, 40)))).mean() < p else (lo, mid)
        expected = 1 / (1 + np.exp(-np.clip(out + lo, -40, 40)))
    else:
        expected = np.full(len(rows), p)
    kept = np.union1d(single, telling_pairs(start, term, labels, expected, size, least))
    if not len(kept):
        return constant
    return m if len(kept) == len(single) else _descend(kept, term, doc, labels, bits, factors, 2 * epochs, rate, l2, seed)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most so many labelled documents, chosen by a hash of their ids."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = settle(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return narrow(docs).join(few(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, bits: int = BITS) -> Machine:
    """The machine fitted on a sample; a document labelled twice counts as toxic if either says so."""

    def terms(batches):
        for b in batches:
            found: list[bytes] = []
            for i, j, row, term in _terms(b.column("text"), bits):
                cut = np.searchsorted(row, np.arange(j - i + 1))
                found += [term[x:y].astype(np.int32).tobytes() for x, y in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "terms"])

    got = sample(docs, labels, most).mapInArrow(terms, "doc_id long, toxic int, terms binary").toArrow().sort_by("doc_id")
    return fit([np.frombuffer(x, np.int32) for x in got["terms"].to_pylist()], got["toxic"].to_numpy(), bits)


def toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """Documents found toxic: (doc_id, score), score at least the threshold.

    Whole texts are scored, however long.  Rows without doc_id or text aren't
    judged; an empty text is clean; equal texts get equal scores; a repeated id is
    listed once, with its highest score.  With labels of one class only, or none,
    and of an empty table nothing is found.  Other columns of docs aren't looked at.
    """
    spark = ready(docs.sparkSession)
    machine = spark.sparkContext.broadcast(train(docs, labels, most))

    def score(batches):
        m = machine.value
        for b in batches:
            s = m.scores(b.column("text"))
            hit = np.flatnonzero(s >= threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(hit)), pa.array(s[hit])], ["doc_id", "score"])

    return narrow(docs).mapInArrow(score, "doc_id long, score double").groupBy("doc_id").agg(F.max("score").alias("score"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the toxic ones; fitted on those of docs that have labels.

    All rows of a doc_id go if one of its texts is toxic; rows that can't be judged stay.
    """
    return without(docs, settle(toxic(docs, labels).select("doc_id")))
