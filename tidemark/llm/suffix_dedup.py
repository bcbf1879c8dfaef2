"""Suffix-array dedup (8): passages of LENGTH words that other documents repeat, by a distributed merge sort of suffixes.

Which suffixes: winnowing keeps, of every SPAN consecutive runs of CORE words,
the one with the least hash.  A passage of LENGTH = CORE + SPAN - 1 words keeps
the same one wherever it occurs, so every repeated passage has a kept place that
is repeated too; only suffixes at places repeated in two documents are sorted.

Sort: each task sorts its suffixes to a run, cuts the run by fixed ranges of the
first symbol and front-codes it: each suffix is sent as the number of symbols
that it shares with the one before, and the rest.  The receiving task combines
the runs of its range by a loser tree whose nodes keep common prefix lengths
with the last winner: two suffixes are compared by these alone where they
differ, and else only from the first symbol that isn't known to be common.  The
merged order comes with the common prefix lengths of neighbours.

A suffix's first symbol is the hash of its CORE words, the others are its next
SPAN - 1 words; with it go the SPAN - 1 words before.  So of each repeated place
the passages that begin 0 to SPAN - 1 words before are told apart exactly: the
words before by their hash, the words after by their class in the merged order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, only, partitions, ready, settle
from .near_dedup import _runs
from .words import Words, mix, pieces

LENGTH, SPAN = 50, 11
_M = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def cores(w: Words, n: int) -> np.ndarray:
    """Hash of the n words from each word on, also across rows; nothing for the last n - 1."""
    count = len(w.h) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    if len(_powers[0]) <= len(w.h):
        for k, r in enumerate((_M, pow(_M, -1, 1 << 64))):
            p = np.full(2 * len(w.h) + 2, r, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    sums = np.zeros(len(w.h) + 1, np.uint64)
    np.cumsum(w.h * _powers[0][: len(w.h)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * _powers[1][:count])


def kept(w: Words, length: int = LENGTH, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of the places that winnowing keeps."""
    g = cores(w, length - span + 1)
    windows = len(w.h) - length + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, have = g, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    least = least[:windows]
    inside = w.row[:windows] == w.row[length - 1 :]
    chosen = np.zeros(len(g), bool)
    for d in range(span):
        chosen[d : d + windows] |= inside & (g[d : d + windows] == least)
    at = np.flatnonzero(chosen)
    return at, g[at]


class Run:
    """A sorted run: first symbols, further symbols (zero beyond the text), words before, and where each suffix is."""

    def __init__(self, first: np.ndarray, after: np.ndarray, before: np.ndarray, doc: np.ndarray, pos: np.ndarray):
        self.first, self.after, self.before, self.doc, self.pos = first, after, before, doc, pos

    def take(self, order) -> Run:
        return Run(self.first[order], self.after[order], self.before[order], self.doc[order], self.pos[order])

    def sort(self) -> Run:
        return self.take(np.lexsort((*self.after.T[::-1], self.first)))

    def common(self) -> np.ndarray:
        """Symbols that each suffix shares with the one before it."""
        out = np.zeros(len(self.first), np.uint8)
        if len(out) > 1:
            same = (self.after[1:] == self.after[:-1]) & (self.after[1:] != 0)
            out[1:] = np.where(self.first[1:] == self.first[:-1], 1 + np.logical_and.accumulate(same, 1).sum(1), 0)
        return out

    def encode(self) -> bytes:
        """Front-coded: symbols shared with the suffix before aren't stored."""
        lcp, width = self.common(), self.after.shape[1]
        size = (self.after != 0).sum(1).astype(np.uint8)
        column = np.arange(width)
        rest = self.after[(column >= np.maximum(lcp, 1)[:, None] - 1) & (column < size[:, None])]
        parts = (lcp, size, self.first[lcp == 0], rest, self.before, self.doc, self.pos)
        return struct.pack("<IIII", len(lcp), width, int((lcp == 0).sum()), len(rest)) + b"".join(np.ascontiguousarray(x).tobytes() for x in parts)

    @staticmethod
    def decode(blob: bytes) -> tuple[Run, np.ndarray]:
        """The run and its common prefix lengths."""
        n, width, heads, tails = struct.unpack_from("<IIII", blob)
        at = 16

        def next_(kind, count):
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        lcp, size = next_(np.uint8, n), next_(np.uint8, n)
        head, rest = next_(np.uint64, heads), next_(np.uint32, tails)
        before, doc, pos = next_(np.uint32, n * width).reshape(n, width), next_(np.int64, n), next_(np.int32, n)
        first = head[np.cumsum(lcp == 0) - 1]
        after = np.zeros((n, width), np.uint32)
        column = np.arange(width)
        own = (column >= np.maximum(lcp, 1)[:, None] - 1) & (column < size[:, None])
        after[own] = rest
        # A shared symbol is that of the last suffix before that has its own one in the column.
        for c in range(width):
            shared = (lcp > c + 1) & (c < size)
            if shared.any():
                source = np.maximum.accumulate(np.where(shared, 0, np.arange(n)))
                after[:, c] = np.where(shared, after[source, c], after[:, c])
        return Run(first, after, before, doc, pos), lcp


def merge(runs: list[tuple[list[tuple], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix length with the one before) of sorted runs in the order of all.

    A run is a list of tuples of symbols and their common prefix lengths.  The
    inner nodes of the tree keep losers with the length that each shares with the
    last winner that passed there.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[] for _ in range(k - len(runs))]
    lengths = [r[1] for r in runs] + [[] for _ in range(k - len(runs))]
    at = [0] * k
    lcp = [0] * k
    done = [not s for s in strings]
    current = [s[0] if s else () for s in strings]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's length is set to what it shares with the winner."""
        if done[b]:
            return a, b
        if done[a]:
            return b, a
        x, y = lcp[a], lcp[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        s, t = current[a], current[b]
        n = min(len(s), len(t))
        while x < n and s[x] == t[x]:
            x += 1
        if x == len(s) or (x < len(t) and s[x] < t[x]):
            lcp[b] = x
            return a, b
        lcp[a] = x
        return b, a

    losers = [0] * k
    winners = [0] * (2 * k)
    winners[k:] = range(k)
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    champion = winners[1] if k > 1 else 0
    while not done[champion]:
        i = at[champion]
        yield champion, i, lcp[champion]
        i += 1
        at[champion] = i
        if i < len(strings[champion]):
            current[champion] = strings[champion][i]
            lcp[champion] = lengths[champion][i]
        else:
            done[champion] = True
        node = (champion + k) // 2
        while node:
            champion, losers[node] = play(champion, losers[node])
            node //= 2


def merged(blobs: list[bytes]) -> tuple[Run, np.ndarray]:
    """Front-coded runs in one sorted run with its common prefix lengths."""
    decoded = [Run.decode(b) for b in blobs]
    runs = []
    for run, lcp in decoded:
        size = (run.after != 0).sum(1).tolist()
        runs.append(([(f, *a[:n]) for f, a, n in zip(run.first.tolist(), run.after.tolist(), size)], lcp.tolist()))
    base = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])
    out = np.array([(base[r] + i, n) for r, i, n in merge(runs)], np.int64).reshape(-1, 2)
    every = Run(*(np.concatenate([getattr(run, f) for run, _ in decoded]) for f in ("first", "after", "before", "doc", "pos")))
    return every.take(out[:, 0]), out[:, 1]


def starts(run: Run, lcp: np.ndarray, span: int, within: bool = False) -> np.ndarray:
    """Bit d of each suffix: the passage that begins d words before it is in another document too, or (within) elsewhere in its own."""
    n = len(lcp)
    mask = np.zeros(n, np.int64)
    size = (run.after != 0).sum(1)
    left = np.zeros(n, np.uint64)
    for d in range(span):
        if d:
            left = mix(left * np.uint64(_M) + run.before[:, -d].astype(np.uint64))
        right = span - 1 - d
        ok = np.flatnonzero((run.pos >= d) & (size >= right))
        if not len(ok):
            continue
        of = np.cumsum(lcp < 1 + right)[ok]
        order = np.lexsort((left[ok], of))
        o, h, doc = of[order], left[ok][order], run.doc[ok][order]
        begin = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])]))
        other = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
        size_of = np.diff(np.append(begin, len(order)))
        hit = np.repeat(other | (size_of > 1) if within else other, size_of)
        mask[ok[order[hit]]] |= 1 << d
    return mask


def repeats(docs: DataFrame, length: int = LENGTH, span: int = SPAN, within: bool = False) -> DataFrame:
    """(doc_id, start_word, end_word, words): the spans of whole documents that are covered by passages of length words which other documents have too.

    Words are compared in lower case and without punctuation.  Spans are as long
    as possible; all documents that have a passage are listed, exact copies
    included.  A passage that only its own document repeats is one if within is
    given; rows that share a doc_id are one document.  Rows without doc_id or text,
    and texts of fewer words, have no spans, nor has an empty table.  Whole texts are
    read, however long; other columns aren't looked at, whatever their names.
    """
    spark = ready(docs.sparkSession)
    core, targets = length - span + 1, partitions(spark)
    texts = narrow(docs)

    def places(batches):
        for b in batches:
            for i, _, w in pieces(b.column("text")):
                at, key = kept(w, length, span)
                if len(at):
                    row = w.row[at]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("doc_id").take(pa.array(row + i)), pa.array((at - w.first[row]).astype(np.int32))], ["key", "doc_id", "pos"])

    same = Window.partitionBy("key")
    repeated = texts.mapInArrow(places, "key long, doc_id long, pos int").withColumn("apart", F.count("*").over(same) > 1 if within else F.min("doc_id").over(same) != F.max("doc_id").over(same)).where("apart")
    listed = settle(repeated.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("pos", "key"))).alias("places")))
    # Texts without a repeated place aren't moved.
    some = only(texts, listed.select("doc_id"))

    def suffixes(batches):
        held = []
        for b in batches:
            lists = b.column("places")
            counts = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            pos, key = flat.field("pos").to_numpy(), flat.field("key").to_numpy().view(np.uint64)
            cut = np.concatenate([[0], np.cumsum(counts)])
            for i, j, w in pieces(b.column("text")):
                row = np.repeat(np.arange(j - i), counts[i:j])
                p, k = pos[cut[i] : cut[j]], key[cut[i] : cut[j]]
                have = np.diff(w.first)[row]
                at = w.first[row] + p
                g = cores(w, core)
                ok = p + core <= have
                ok[ok] = g[at[ok]] == k[ok]  # a repeated doc_id has other texts' places
                row, p, k, at, have = row[ok], p[ok], k[ok], at[ok], have[ok]
                if not len(p):
                    continue
                code = (w.h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                step = np.arange(span - 1)
                place = p[:, None] + core + step
                after = np.where(place < have[:, None], code[np.minimum(at[:, None] + core + step, len(code) - 1)], np.uint32(0))
                place = p[:, None] - (span - 1) + step
                before = np.where(place >= 0, code[np.maximum(at[:, None] - (span - 1) + step, 0)], np.uint32(0))
                ids = b.column("doc_id").to_numpy()[row + i]
                held.append(Run(k, after, before, ids.astype(np.int64), p.astype(np.int32)))
        if not held:
            return
        run = Run(*(np.concatenate([getattr(r, f) for r in held]) for f in ("first", "after", "before", "doc", "pos"))).sort()
        target = ((run.first >> np.uint64(32)) * np.uint64(targets) >> np.uint64(32)).astype(np.int64)
        begin = np.flatnonzero(np.diff(target, prepend=-1))
        end = np.append(begin[1:], len(target))
        blobs = [run.take(slice(x, y)).encode() for x, y in zip(begin, end)]
        yield pa.RecordBatch.from_arrays([pa.array(target[begin].astype(np.int32)), pa.array(blobs, pa.binary())], ["target", "run"])

    runs = listed.join(some, "doc_id").select("doc_id", "text", "places").mapInArrow(suffixes, "target int, run binary")

    def combine(batches):
        for t in _runs(batches, ["target"]):
            run, lcp = merged(t["run"].to_pylist())
            mask = starts(run, lcp, span, within)
            hit = np.flatnonzero(mask)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(run.doc[hit]), pa.array(run.pos[hit]), pa.array(mask[hit])], ["doc_id", "pos", "mask"])

    found = runs.repartition(targets, "target").sortWithinPartitions("target").mapInArrow(combine, "doc_id long, pos int, mask long")

    def spans(batches):
        for t in _runs(batches, ["doc_id"]):
            pos, mask = t["pos"].to_numpy(), t["mask"].to_numpy()
            s = np.unique(np.concatenate([pos[(mask >> d) & 1 == 1] - d for d in range(span)]).astype(np.int64))
            begin = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1] + length]))
            lo, hi = s[begin], s[np.append(begin[1:] - 1, len(s) - 1)] + length
            yield pa.RecordBatch.from_arrays([pa.array([t["doc_id"][0].as_py()] * len(lo), pa.int64()), pa.array(lo), pa.array(hi), pa.array(hi - lo)], ["doc_id", "start_word", "end_word", "words"])

    return found.repartition(targets, "doc_id").sortWithinPartitions("doc_id").mapInArrow(spans, "doc_id long, start_word long, end_word long, words long")
