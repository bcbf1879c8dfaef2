"""Benchmark decontamination (6): every training passage queries a BM25 index of the test items.

Whole documents are cut into overlapping passages, long enough that any run of
the longest item's length lies within one.  A passage is a query; block-max
WAND finds all items whose BM25 score, as a share of the item's score for
itself, reaches THRESHOLD.  Items are cut into BLOCKS ranges and each term has
its greatest impact in each.  The sums of these over a passage's terms bound
all scores in a range; they're computed for a whole Arrow batch of passages at
once, and WAND runs over the ranges whose bound reaches the threshold only:
that leaves out no item that could reach it.  The items found are then
verified: enough word n-grams of the question and of the answer, where columns
say which they are, and else of the whole item must occur in the passage.

The index is broadcast in shards of at most SHARD_ITEMS items, so that what an
executor holds doesn't grow with the benchmarks; each shard is one more pass.
Document frequencies, mean and longest length are those of all items, so scores
and passages don't depend on how the items are cut.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, ready, settle, without
from .words import Words, pieces, strings

K1, B = 1.2, 0.75
THRESHOLD = 0.5
#: Share of the n-grams of the question (or of an item that isn't parted) and of the answer that a passage must have, and words of an n-gram.
QUESTION, ANSWER, GRAM = 0.5, 0.5, 3
BLOCKS = 64
SHARD_ITEMS = 20_000


def _words(questions: list[str | None], answers: list[str | None] | None) -> Words:
    texts = questions if answers is None else [f"{q or ''}\n{a or ''}" for q, a in zip(questions, answers)]
    return Words(strings(pa.array(texts, pa.string())))


class Corpus:
    """What BM25 has to know of all items: how many there are and how long, and in how many each term is."""

    def __init__(self):
        self.n = self.words = self.longest = 0
        self.terms, self.df = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, questions: list[str | None], answers: list[str | None] | None = None) -> Corpus:
        w = _words(questions, answers)
        length = np.diff(w.first)
        self.n += len(length)
        self.words += int(length.sum())
        self.longest = max(self.longest, int(length.max(initial=0)))
        own = [np.unique(w.h[a:b]) for a, b in zip(w.first[:-1], w.first[1:])]
        terms, at = np.unique(np.concatenate([self.terms, *own]), return_inverse=True)
        self.df = np.bincount(at, np.concatenate([self.df, np.ones(len(at) - len(self.df))]), len(terms)).astype(np.int64)
        self.terms = terms
        return self

    @property
    def mean(self) -> float:
        return max(1.0, self.words / self.n) if self.n else 1.0


class Index:
    """An inverted index with block-max impacts, each item's impacts being shares of its own score."""

    def __init__(self, ids: list[int], questions: list[str | None], answers: list[str | None] | None = None, corpus: Corpus | None = None):
        corpus = corpus or Corpus().add(questions, answers)
        w = _words(questions, answers)
        self.ids = np.array(ids, np.int64)
        n = len(ids)
        length = np.diff(w.first)
        self.passage = max(16, 2 * corpus.longest)
        self.terms, term = np.unique(w.h, return_inverse=True)
        key, tf = np.unique(term.astype(np.int64) * max(n, 1) + w.row, return_counts=True)
        term, item = key // max(n, 1), key % max(n, 1)
        df = corpus.df[np.searchsorted(corpus.terms, self.terms)]
        idf = np.log1p((corpus.n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / corpus.mean))
        own = np.bincount(item, impact, n)
        impact = impact / np.maximum(own[item], 1e-12)
        cut = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.items = [item[a:b] for a, b in zip(cut[:-1], cut[1:])]
        self.impacts = [impact[a:b] for a, b in zip(cut[:-1], cut[1:])]
        self.block = max(1, -(-n // BLOCKS))
        self.bounds = np.zeros((len(self.terms), max(1, -(-n // self.block))), np.float32)
        # Rounded up, so that sums in single precision stay bounds.
        np.maximum.at(self.bounds, (term, item // self.block), (impact * (1 + 1e-5)).astype(np.float32))
        self.question: list[np.ndarray] = []
        self.answer: list[np.ndarray] = []
        parts = Words(strings(pa.array(answers, pa.string()))) if answers is not None else None
        for k in range(n):
            h = w.h[w.first[k] : w.first[k + 1]]
            if parts is None:
                self.question.append(_grams(h))
                continue
            size = int(parts.first[k + 1] - parts.first[k])
            self.question.append(_grams(h[: len(h) - size]))
            self.answer.append(_grams(h[len(h) - size :]))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term numbers of hashes, or -1."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def wand(self, terms: np.ndarray, threshold: float, lo: int = 0, hi: int | None = None) -> list[tuple[int, float]]:
        """All (item, score) with at least the threshold for a query of distinct terms, of the items lo..hi."""
        lists = []
        for t in terms.tolist():
            a, b = np.searchsorted(self.items[t], (lo, len(self.ids) if hi is None else hi))
            if a < b:
                items, impacts = self.items[t][a:b].tolist(), self.impacts[t][a:b].tolist()
                lists.append([items[0], 0, items, impacts, max(impacts)])
        found = []
        slack = threshold - 1e-9
        while lists:
            lists.sort(key=lambda x: x[0])
            # The pivot: the first item at which the lists so far could together reach the threshold.
            total, pivot = 0.0, -1
            for entry in lists:
                total += entry[4]
                if total >= slack:
                    pivot = entry[0]
                    break
            if pivot < 0:
                break
            scored = lists[0][0] == pivot
            score = 0.0
            for entry in lists:
                if entry[0] > pivot:
                    break
                at, items = entry[1], entry[2]
                if scored:
                    score += entry[3][at]
                    at += 1
                else:
                    at = bisect_left(items, pivot, at)
                entry[1] = at
                entry[0] = items[at] if at < len(items) else -1
            if scored and score >= slack:
                found.append((pivot, score))
            lists = [x for x in lists if x[0] >= 0]
        return found

    def overlap(self, item: int, h: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and of the answer's n-grams that occur in a passage; both that of the whole item where it isn't parted."""
        shares = []
        for part in (self.question[item], self.answer[item] if self.answer else self.question[item]):
            shares.append(float(np.isin(part[1], _grams(h, part[0])[1]).mean()) if len(part[1]) else 1.0)
        return shares[0], shares[1]


def _grams(h: np.ndarray, n: int = 0):
    """(n, distinct hashes of the n-grams); n is GRAM, or less for parts of fewer words."""
    n = n or max(1, min(GRAM, len(h)))
    if len(h) < n:
        return n, np.zeros(0, np.uint64)
    g = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(g)]
    return n, np.unique(g)


def _sums(table: np.ndarray, which: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of the table by group, in steps of bounded memory; group is sorted."""
    out = np.zeros((n, table.shape[1]), np.float32)
    step = 1 << 16
    for a in range(0, len(which), step):
        g = group[a : a + step]
        begins = np.flatnonzero(np.diff(g, prepend=-1))
        out[g[begins]] += np.add.reduceat(table[which[a : a + step]], begins, axis=0)
    return out


def leaks(texts: pa.Array, index: Index, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(row, item, score, question overlap, answer overlap, first word) of the verified passages."""
    stride = index.passage // 2
    if not len(index.terms):
        return
    for i, j, w in pieces(texts):
        if not len(w.h):
            continue
        term = index.lookup(w.h)
        place = np.arange(len(w.h)) - w.first[w.row]
        known = np.flatnonzero(term >= 0)
        if not len(known):
            continue
        # Distinct terms by half passage; a passage is a half and the next one.
        halves = np.diff(w.first) // stride + 1
        base = np.concatenate([[0], np.cumsum(halves)])
        half = base[w.row[known]] + place[known] // stride
        key = np.unique(half * len(index.terms) + term[known])
        half, which = key // len(index.terms), key % len(index.terms)
        bound = _sums(index.bounds, which, half, base[-1] + 1)
        row_of = np.repeat(np.arange(j - i), halves)
        following = np.append(row_of[1:] == row_of[:-1], False)
        bound[:-1][following] += bound[1:][following]
        possible = np.flatnonzero(bound[:-1].max(1) >= threshold)
        if not len(possible):
            continue
        # The same bound again, with terms that both halves have counted once.
        cut = np.searchsorted(half, np.arange(base[-1] + 2))
        count = cut[possible + 1 + following[possible]] - cut[possible]
        at = np.repeat(cut[possible] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        key = np.unique(np.repeat(np.arange(len(possible)), count) * len(index.terms) + which[at])
        passage, term = key // len(index.terms), key % len(index.terms)
        bound = _sums(index.bounds, term, passage, len(possible))
        cut = np.searchsorted(passage, np.arange(len(possible) + 1))
        for k in np.flatnonzero(bound.max(1) >= threshold).tolist():
            p, terms = int(possible[k]), term[cut[k] : cut[k + 1]]
            row = int(row_of[p])
            start = int(w.first[row] + (p - base[row]) * stride)
            h = w.h[start : min(start + 2 * stride, w.first[row + 1])]
            for b in np.flatnonzero(bound[k] >= threshold).tolist():
                for item, score in index.wand(terms, threshold, b * index.block, (b + 1) * index.block):
                    q, a = index.overlap(item, h)
                    if q >= QUESTION and a >= ANSWER:
                        yield i + row, item, score, q, a, start - int(w.first[row])


def _shards(benchmark: DataFrame) -> Iterator[Index]:
    columns = {"question", "answer"} <= set(benchmark.columns)
    parts = (F.col("question"), F.col("answer")) if columns else (F.col("text"), F.lit(None))
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), parts[0].cast("string").alias("q"), parts[1].cast("string").alias("a")).where("q IS NOT NULL")
    items = settle(items)

    def cut() -> Iterator[tuple[list, list, list | None]]:
        held: list = []
        for r in items.orderBy("item_id", "q", "a").toLocalIterator():
            held.append(r)
            if len(held) == SHARD_ITEMS:
                yield [x.item_id for x in held], [x.q for x in held], [x.a for x in held] if columns else None
                held = []
        if held:
            yield [x.item_id for x in held], [x.q for x in held], [x.a for x in held] if columns else None

    corpus = Corpus()
    for _, questions, answers in cut():
        corpus.add(questions, answers)
    for ids, questions, answers in cut():
        yield Index(ids, questions, answers, corpus)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, word): documents that hold a test item, and about where.

    One row for each document and item, that of the best passage (of equal ones
    the first).  Rows without doc_id or text, and items without item_id, text or
    words, match nothing; of items with equal texts each is reported.  Rows that
    share a doc_id are one document.  Whole texts are searched, however long; a
    passage is twice as long as the longest item.  Empty tables have no matches.
    """
    spark = ready(docs.sparkSession)
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word long"
    texts = narrow(docs)

    def run(kept):
        def search(batches):
            index = kept.value
            for b in batches:
                rows = list(leaks(b.column("text"), index, threshold))
                if not rows:
                    continue
                row, item, score, q, a, word = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(index.ids[list(item)]), pa.array(score), pa.array(q), pa.array(a), pa.array(word, pa.int64())], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word"])

        return texts.mapInArrow(search, schema)

    found = [run(spark.sparkContext.broadcast(x)) for x in _shards(benchmark)]
    if not found:
        return spark.createDataFrame([], schema)
    best = F.max_by(F.struct("score", "question_overlap", "answer_overlap", "word"), F.struct("score", (-F.col("word")).alias("early"))).alias("best")
    return reduce(DataFrame.union, found).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a test item."""
    return without(docs, settle(contaminated(docs, benchmark).select("doc_id").distinct()))
