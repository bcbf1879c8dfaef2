"""MinHash near-dedup (1) with SetSketch registers.

Each document is the set of its word 3-grams.  Register i keeps
K_i = floor(1 - log_b min h_i) over the set, with h_i exponential of rate a and
K_i truncated to 0..q+1: exponentially spaced minima that merge by max and of
which two sets share about as many as their Jaccard similarity says.

1. Bands of ROWS register values put documents into buckets.  Documents with
   equal registers are first reduced to one, and buckets with the same members
   to one bucket, both exactly.
2. In a bucket all pairs are estimated jointly by likelihood from how many
   registers are greater, smaller and equal.  Of the pairs within SLACK of the
   threshold a maximum spanning forest is kept: it joins at every level of
   similarity the same documents as all pairs, with fewer edges than documents.
   Buckets of over BLOCK documents are cut into pairs of blocks, all of which
   are compared, by different tasks.
3. Every edge left is verified by the exact similarity of the two whole texts.
   Connected components, by alternating large and small stars, are the first groups.
4. Where an edge of a forest failed, the pairs that the forest left out for it
   count: the whole texts of that bucket's documents are brought together, and all
   its pairs within SLACK whose ends no verified pair connects yet are verified
   there, the likeliest first.  The components with these pairs are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, only, partitions, ready, settle, without
from .words import Words, pieces

GRAM = 3
THRESHOLD = 0.5
SLACK = 0.12
REGISTERS, ROWS = 128, 4
BASE, RATE, TOP = 1.02, 20.0, (1 << 15) - 2
BLOCK = 2048

_rng = np.random.default_rng(20_240_229)
_FACTORS = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_ADDENDS = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def shingles(w: Words, n_rows: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all word n-grams; a text of fewer words is one shingle, one without words has none."""
    h, at = w.grams(gram)
    row = w.row[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < gram))
    if len(short):
        extra = [int(np.bitwise_xor.reduce(w.h[w.first[r] : w.first[r + 1]] * np.arange(1, 2 * count[r], 2, dtype=np.uint64))) for r in short]
        row, h = np.concatenate([row, short]), np.concatenate([h, np.array(extra, np.uint64)])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return row, h


def registers(least: np.ndarray) -> np.ndarray:
    """Register values of the least 32-bit hashes."""
    h = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def sketches(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, rows that have words, their registers), by ranges of rows."""
    for i, j, w in pieces(texts):
        row, h = shingles(w, j - i)
        if not len(h):
            continue
        x = (h >> np.uint64(32)).astype(np.uint32)
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.empty((len(begins), REGISTERS), np.uint32)
        buffer = np.empty_like(x)
        for k in range(REGISTERS):
            np.multiply(x, _FACTORS[k], out=buffer)
            np.add(buffer, _ADDENDS[k], out=buffer)
            least[:, k] = np.minimum.reduceat(buffer, begins)
        yield i, row[begins], registers(least)


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(one, other)


def cardinality(regs: np.ndarray) -> np.ndarray:
    return regs.shape[-1] * (1 - 1 / BASE) / (RATE * np.log(BASE) * (BASE ** -regs.astype(float)).sum(-1))


def likeliest(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> np.ndarray:
    """Jaccard similarities of greatest likelihood, given in how many registers one set is greater, less and equal, and both sizes."""
    u = n_one / (n_one + n_other)
    v = 1 - u
    scale = (BASE - 1) / BASE

    def log_likelihood(j):
        p = -np.log1p(-np.clip(u - v * j, 0, 1) * scale) / np.log(BASE)
        m = -np.log1p(-np.clip(v - u * j, 0, 1) * scale) / np.log(BASE)
        tiny = 1e-12
        return greater * np.log(p + tiny) + less * np.log(m + tiny) + equal * np.log(np.maximum(1 - p - m, 0) + tiny)

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(18):  # the likelihood is concave
        a, b = hi - 0.618034 * (hi - lo), lo + 0.618034 * (hi - lo)
        left = log_likelihood(a) >= log_likelihood(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


def _pairs(ids: np.ndarray, regs: np.ndarray, side: np.ndarray | None, floor: float, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, estimate) of the pairs estimated at the floor or above, the likeliest first; with two blocks, of those across them, with groups, of those between two."""
    n = len(ids)
    size = cardinality(regs)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 23) // (n * regs.shape[1]))
    for a in range(0, n, step):
        b = min(n, a + step)
        equal = (regs[a:b, None, :] == regs[None, :, :]).sum(-1)
        # A share of equal registers far below the floor can't be estimated at the floor.
        i, j = np.nonzero(equal >= (floor - 0.12) * regs.shape[1])
        keep = i + a < j
        if side is not None:
            keep &= side[i + a] != side[j]
        if group is not None:
            keep &= group[i + a] != group[j]
        i, j = i[keep] + a, j[keep]
        if len(i):
            for c in range(0, len(i), 1 << 16):
                x, y = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                e = equal[x - a, y]
                g = (regs[x] > regs[y]).sum(-1)
                est = likeliest(g, regs.shape[1] - e - g, e, size[x], size[y])
                ok = est >= floor
                found.append((x[ok], y[ok], est[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    x, y, est = (np.concatenate(k) for k in zip(*found))
    order = np.lexsort((ids[y], ids[x], -est))
    return x[order], y[order], est[order]


def _root(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def _forest(ids: np.ndarray, regs: np.ndarray, side: np.ndarray | None, floor: float) -> Iterator[tuple[int, int, float]]:
    """Edges of a maximum spanning forest of the pairs estimated at the floor or above; with two blocks, of the pairs across them."""
    parent = list(range(len(ids)))
    for x, y, est in zip(*(k.tolist() for k in _pairs(ids, regs, side, floor))):
        p, q = _root(parent, x), _root(parent, y)
        if p != q:
            parent[q] = p
            one, other = int(ids[x]), int(ids[y])
            if one != other:
                yield min(one, other), max(one, other), est


def _joining(ids: np.ndarray, regs: np.ndarray, side: np.ndarray | None, group: np.ndarray, texts: pa.Array, floor: float, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(a, b, jaccard) of exactly verified pairs that connect all groups which any pair at the floor or above connects."""
    label, own = np.unique(group, return_inverse=True)
    x, y, _ = _pairs(ids, regs, side, floor, own)
    used = np.unique(np.concatenate([x, y]))
    sets = dict(zip(used.tolist(), _sets(texts.take(pa.array(used)))))
    parent = list(range(len(label)))
    for i, j in zip(x.tolist(), y.tolist()):
        p, q = _root(parent, int(own[i])), _root(parent, int(own[j]))
        if p != q and (jaccard := _jaccard(sets[i], sets[j])) >= threshold:
            parent[q] = p
            yield min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j])), jaccard


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, regs, signature) of the documents with words."""

    def sketch(batches):
        for b in batches:
            for i, rows, regs in sketches(b.column("text")):
                ids = b.column("doc_id").take(pa.array(rows + i))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "regs"])

    return narrow(docs).mapInArrow(sketch, "doc_id long, regs binary").withColumn("signature", F.xxhash64("regs"))


def _bands(batches):
    for b in batches:
        regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS // ROWS, ROWS).astype(np.uint64)
        key = np.full(regs.shape[:2], 0, np.uint64) + np.arange(regs.shape[1], dtype=np.uint64)
        for k in range(ROWS):
            key = key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, k] + np.uint64(1)
            key ^= key >> np.uint64(29)
        ids = np.repeat(b.column("doc_id").to_numpy(), regs.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(key.ravel().view(np.int64))], ["doc_id", "key"])


def _runs(batches, columns: list[str]) -> Iterator[pa.Table]:
    """Tables of rows that agree in the given columns, of batches sorted by them."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        keys = [t[c].to_numpy() for c in columns]
        change = np.zeros(len(t), bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(t)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            now = tuple(k[x] for k in keys)
            if held and now != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(x, y - x))
            last = now
    if held:
        yield pa.concat_tables(held)


#: What is compared by itself: a bucket, known by its members, or a pair of its blocks.
_TASK = ["members", "also", "i", "j"]


def buckets(chosen: DataFrame) -> DataFrame:
    """(doc_id, members, also, i, j, own): the documents of each bucket, by pairs of blocks; own is a document's block."""
    bucket = Window.partitionBy("key")
    rows = (
        chosen.mapInArrow(_bands, "doc_id long, key long")
        .withColumn("n", F.count("*").over(bucket))
        .where("n > 1")
        .withColumn("members", F.bit_xor(F.xxhash64("doc_id")).over(bucket))
        .withColumn("also", F.bit_xor(F.xxhash64("doc_id", F.lit(1))).over(bucket))
        .select("doc_id", "n", "members", "also")
        .distinct()
    )
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    return (
        rows.withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("doc_id", "members", "also", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    )


def _by_task(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), *_TASK).sortWithinPartitions(*_TASK)


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ids, registers and, with two blocks, the side of each row of a task."""
    regs = np.frombuffer(b"".join(t["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    return t["doc_id"].to_numpy(), regs, t["own"].to_numpy() if t["i"][0] != t["j"][0] else None


def candidates(rows: DataFrame, chosen: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges (a, b, estimate) with their task, which join all documents of the task whose estimates are within SLACK of the threshold."""
    floor = threshold - SLACK

    def edges(batches):
        for t in _runs(batches, _TASK):
            if len(t) < 2:
                continue
            got = list(_forest(*_arrays(t), floor))
            if got:
                a, b, e = zip(*got)
                task = [t[c].combine_chunks().take(pa.array([0] * len(got))) for c in _TASK]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.float64()), *task], ["a", "b", "estimate", *_TASK])

    return _by_task(rows.join(chosen, "doc_id")).mapInArrow(edges, "a long, b long, estimate double, members long, also long, i int, j int")


def rest(rows: DataFrame, chosen: DataFrame, groups: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified edges (a, b, jaccard) that connect what the tasks' pairs within SLACK connect beyond the groups (doc_id, group_id)."""
    floor = threshold - SLACK
    group = F.coalesce("group_id", "doc_id")
    task = Window.partitionBy(*_TASK)
    rows = rows.join(groups, "doc_id", "left").withColumn("group_id", group)
    rows = settle(rows.withColumn("least", F.min("group_id").over(task)).withColumn("most", F.max("group_id").over(task)).where("least < most").drop("least", "most"))
    texts = only(narrow(docs), settle(rows.select("doc_id").distinct()))

    def edges(batches):
        for t in _runs(batches, _TASK):
            got = list(_joining(*_arrays(t), t["group_id"].to_numpy(), t["text"].combine_chunks(), floor, threshold))
            if got:
                a, b, jaccard = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(jaccard, pa.float64())], ["a", "b", "jaccard"])

    return _by_task(rows.join(chosen, "doc_id").join(texts, "doc_id")).mapInArrow(edges, "a long, b long, jaccard double")


def _sets(texts: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for i, j, w in pieces(texts):
        row, h = shingles(w, j - i)
        cut = np.searchsorted(row, np.arange(j - i + 1))
        out += [np.unique(h[x:y]) for x, y in zip(cut[:-1], cut[1:])]
    return out


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    c = len(np.intersect1d(x, y, assume_unique=True))
    return c / max(1, len(x) + len(y) - c)


def verified(edges: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges (a, b, jaccard) whose whole texts are at least as similar as the threshold, exactly."""
    ids = settle(edges.select(F.col("a").alias("doc_id")).union(edges.select(F.col("b").alias("doc_id"))).distinct())
    texts = only(narrow(docs), ids)
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def check(batches):
        for b in batches:
            pairs = zip(_sets(b.column("text_a")), _sets(b.column("text_b")))
            j = np.array([_jaccard(x, y) for x, y in pairs])
            ok = pa.array(np.flatnonzero(j >= threshold))
            yield pa.RecordBatch.from_arrays([b.column("a").take(ok), b.column("b").take(ok), pa.array(j).take(ok)], ["a", "b", "jaccard"])

    return edges.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, jaccard double")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group_id) of all ends of edges (a, b); group_id is the smallest id that is connected."""
    at = settle(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct())
    state = None
    while True:
        # Large star: all larger neighbours of a node go to its smallest one.
        both = at.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(at.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
        large = least.where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        small = large.withColumn("m", F.min("lo").over(Window.partitionBy("hi")))
        both = small.select(F.col("m").alias("lo"), F.col("hi")).union(small.select(F.col("m").alias("lo"), F.col("lo").alias("hi")))
        at = settle(both.where("lo <> hi").distinct())
        now = at.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if now == state or not now[0]:
            break
        state = now
    return at.select(F.col("hi").alias("doc_id"), F.col("lo").alias("group_id"))


def near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of, group_size): documents whose group has one with a smaller id, duplicate_of.

    A group holds the documents that verified pairs connect, exact copies
    included.  Rows without doc_id or text, and texts without words, are in no
    group; texts of fewer than GRAM words equal only texts of the same words; rows
    that share a doc_id are one document, near another if one of its texts is.  Whole
    texts are compared, however long; an empty table has no groups; other columns
    aren't looked at, whatever their names.
    """
    ready(docs.sparkSession)
    marked = settle(sketched(docs).withColumn("first", F.min("doc_id").over(Window.partitionBy("signature"))))
    same = marked.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    chosen = marked.where("doc_id = first").select("doc_id", "regs")
    rows = settle(buckets(chosen))
    edges = settle(candidates(rows, chosen, threshold))
    sure = settle(verified(edges.select("a", "b").union(same).distinct(), docs, threshold).select("a", "b"))
    pairs = components(sure)
    again = settle(edges.join(sure, ["a", "b"], "left_anti").select(*_TASK).distinct())
    if not again.isEmpty():
        more = rest(rows.join(again, _TASK, "left_semi"), chosen, pairs, docs, threshold)
        pairs = components(pairs.select(F.col("group_id").alias("a"), F.col("doc_id").alias("b")).union(more.select("a", "b")))
    sizes = pairs.groupBy("group_id").agg((F.count("*") + 1).alias("group_size"))
    return pairs.join(sizes, "group_id").select("doc_id", F.col("group_id").alias("duplicate_of"), "group_size")


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id.  Rows that are in no group stay."""
    return without(docs, settle(near_copies(docs, threshold).select("doc_id")))
