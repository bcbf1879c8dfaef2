"""Mixing sources to target weights (3) by a multivariate-hypergeometric splitting tree.

Without given weights the mix has all documents, or a given total of them that
the sources share by size to the power TEMPERATURE: a source too small for its
share is taken entirely, and the others share the rest.

Each source's documents are put in a keyed random order and cut into blocks.
The mix takes a whole number of blocks' worth of each source, its quota.  A
binary tree then splits the root's vector of quotas among the output shards:
a node hands its left half a draw without replacement (multivariate
hypergeometric) of the left half's size and the rest to the right.  So the
quotas are exact, every shard has its exact size, and each leaf says how many
blocks of each source its shard takes.  Prefix sums over the shards turn that
into disjoint ranges of blocks, and each shard is shuffled by itself.

A row's place in its source is found without putting a source in one task:
ranges of the rows' hashes are counted, and hashes are numbered within their
range only.  As a shard takes consecutive blocks of a source, it is a range of
hashes too, so only hashes are sorted, and texts are shuffled once, to their shard.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, partitions, ready, settle

#: Documents of a block, and of a shard (about).
BLOCK, SHARD = 16, 4096
#: Most numbers of the tree's top that the driver holds: sources times nodes.
TOP = 1 << 20
#: Where no weights are given, a source weighs as its size to this power in a total less than all documents.
TEMPERATURE = 0.7
SEED = 17
UNKNOWN = "(no source)"


def filled(sizes: Mapping[str, int], weights: Mapping[str, float], total: int) -> dict[str, float]:
    """Documents of each source in a total shared by weight: a source too small for its share is taken entirely, and the others share the rest."""
    out: dict[str, float] = {}
    rest, left = float(min(total, sum(sizes[s] for s in weights))), sum(weights.values())
    # The sources that run out first come first.
    for s in sorted(weights, key=lambda s: (sizes[s] / weights[s], s)):
        out[s] = min(float(sizes[s]), rest * min(1.0, weights[s] / left) if left > 0 else rest)
        rest, left = rest - out[s], left - weights[s]
    return out


def targets(sizes: Mapping[str, int], weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, total: int | None = None) -> dict[str, float]:
    """Weights that sum to 1; a source without documents gets none, and a source that no weight is given for isn't used.

    With a total, or without given weights (the total is then all documents),
    these are the shares that the sources can fill.
    """
    given = {s: float(n) ** temperature for s, n in sizes.items() if n > 0} if weights is None else {s: w for s, w in weights.items() if w > 0 and sizes.get(s, 0) > 0}
    if weights is None and total is None:
        total = sum(sizes[s] for s in given)
    if given and total is not None:
        available = sum(sizes[s] for s in given)
        given = {s: float(sizes[s]) for s in given} if total >= available else {s: n for s, n in filled(sizes, given, total).items() if n > 0}
    whole = sum(given.values())
    return {s: w / whole for s, w in sorted(given.items())} if whole else {}


def quotas(sizes: Mapping[str, int], weights: Mapping[str, float], total: int | None = None) -> dict[str, int]:
    """Documents to take of each source: the most for which the weights can be met without taking any twice, or a total if that is less.

    Fractions are given out by largest remainder, ties by name.
    """
    if not weights:
        return {}
    most = int(min(sizes[s] / w for s, w in weights.items()) * (1 + 1e-12) + 1e-9)
    total = most if total is None else min(total, most)
    exact = {s: total * w for s, w in weights.items()}
    out = {s: min(int(x + 1e-9), sizes[s]) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: max(0, total - sum(out.values()))]:
        out[s] = min(out[s] + 1, sizes[s])
    return out


def split(index: np.ndarray, blocks: np.ndarray, total: int, shards: int, lo: int, hi: int, seed: int = SEED, most: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, sources, blocks) of the nodes of at most so many shards below the node lo..hi, which has the given blocks of the given sources.

    Shards get equal numbers of blocks but for one more in some.  A node's draw
    depends on the seed and the node alone, so a tree can be split at any level
    and gone on with elsewhere; sources that a node has no block of aren't listed.
    """
    end = lambda k: total * k // shards
    stack = [(lo, hi, index, blocks)]
    while stack:
        lo, hi, index, have = stack.pop()
        if hi - lo <= most:
            yield lo, hi, index, have
            continue
        mid = (lo + hi) // 2
        left = _draw(np.random.default_rng([seed, lo, hi]), have, end(mid) - end(lo))
        for a, b, x in ((lo, mid, left), (mid, hi, have - left)):
            some = np.flatnonzero(x)
            stack.append((a, b, index[some], x[some]))


def _draw(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw, source by source, as numpy's own draws from less than a billion at once."""
    left = np.zeros_like(have)
    rest = int(have.sum())
    for k, x in enumerate(have.tolist()):
        if n <= 0:
            break
        rest -= x
        left[k] = rng.hypergeometric(x, rest, n) if x and rest else min(x, n)
        n -= int(left[k])
    return left


def _leaves(spark: SparkSession, names: list[str], per: list[int], shards: int, seed: int) -> DataFrame:
    """(_source, shard, _blocks): the tree's leaves. The driver splits its top, executors the rest."""
    total = sum(per)
    nodes = max(1, min(256, TOP // max(1, len(names))))
    top = split(np.arange(len(names)), np.array(per, np.int64), total, shards, 0, shards, seed, max(1, -(-shards // nodes)))
    table = spark.createDataFrame([(lo, hi, [names[k] for k in i.tolist()], b.tolist()) for lo, hi, i, b in top], "lo long, hi long, names array<string>, blocks array<long>")

    def run(batches):
        for b in batches:
            for lo, hi, own, blocks in zip(*(b.column(c).to_pylist() for c in ("lo", "hi", "names", "blocks"))):
                for k, _, i, n in split(np.arange(len(own)), np.array(blocks, np.int64), total, shards, lo, hi, seed):
                    yield pa.RecordBatch.from_arrays([pa.array([own[x] for x in i.tolist()], pa.string()), pa.array([k] * len(i), pa.int64()), pa.array(n, pa.int64())], ["_source", "shard", "_blocks"])

    return table.repartition(min(nodes, partitions(spark))).mapInArrow(run, "_source string, shard long, _blocks long")


def _hash(docs: DataFrame, seed: int) -> Column:
    """A hash of the whole row; nulls count, and columns that have no hash go as JSON."""
    parts = []
    for f in docs.schema.fields:
        c = docs[f.name]
        flat = not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        parts += [c.isNull(), c if flat else F.to_json(F.struct(c.alias("c")), {"ignoreNullFields": "false"})]
    return F.xxhash64(F.lit(seed), *parts)


def _apart(rows: DataFrame, tied: DataFrame) -> DataFrame:
    """Rows with hashes of their own where a hash occurs twice: equal rows are counted, not gathered, and written out again."""
    tied = few(tied.select(F.col("_hash").alias("_tied")))
    same = rows["_hash"] == tied["_tied"]
    alike = rows.join(tied, same, "left_semi").groupBy("_hash", "_check").agg(F.first("_doc").alias("_doc"), F.first("_source").alias("_source"), F.count("*").alias("_n"))
    copies = alike.select("_doc", "_source", "_hash", "_check", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy"))
    return rows.join(tied, same, "left_anti").select("_doc", "_source", "_hash").union(copies.select("_doc", "_source", F.xxhash64("_hash", "_check", "_copy")))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, block: int = BLOCK, shard_docs: int = SHARD, seed: int = SEED, total: int | None = None) -> DataFrame:
    """docs' columns with shard and position: an exact mix of the sources without any document twice.

    Given weights are met exactly, by as many documents as that leaves room for,
    unless a total is given.  Without weights the total is all documents.
    Rows without a source form one source, UNKNOWN; rows without doc_id or text
    are rows like others, and so are empty and very long texts.  Rows that repeat
    are rows of their own; as the order is by a hash of whole rows, rows that tie
    are equal, and the mix is the same however docs is partitioned.  The last
    block of a source may have fewer documents.  An empty table, or weights for
    absent sources only, gives no rows.  Columns of docs named shard or position
    are replaced.
    """
    spark = ready(docs.sparkSession)
    docs = docs.drop("shard", "position")
    source = F.coalesce(F.col("source").cast("string"), F.lit(UNKNOWN))
    # The columns of docs travel as one struct, so that no name of theirs meets one from here.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), source.alias("_source"), _hash(docs, seed).alias("_hash"), _hash(docs, seed + 7).alias("_check"))
    thin = settle(rows.select("_source", "_hash"))
    tied = settle(thin.groupBy("_hash").count().where("count > 1").select("_hash"))
    if tied.isEmpty():
        rows = rows.drop("_check")
    else:
        rows = _apart(rows, tied)
        thin = settle(rows.select("_source", "_hash"))
    # Ranges of the hash, about as many as there are tasks; the top bits of a hash are even.
    bits = max(4, int(np.ceil(np.log2(max(2, partitions(spark))))) + 2)
    span = F.shiftright("_hash", 64 - bits).cast("int")
    counts = settle(thin.groupBy("_source", span.alias("_range")).agg(F.count("*").alias("_n")))
    sizes = {r["_source"]: r["n"] for r in counts.groupBy("_source").agg(F.sum("_n").alias("n")).collect()}
    take = quotas(sizes, targets(sizes, weights, temperature, total), total)
    names = [s for s in take if take[s] > 0]
    if not names:
        return docs.withColumn("shard", F.lit(0)).withColumn("position", F.lit(0).cast("long")).limit(0)
    shards = max(1, round(sum(take.values()) / shard_docs))
    # Shard k's blocks of a source are those from the sum over the shards before it; beyond the quota there is no shard.
    leaves = _leaves(spark, names, [-(-take[s] // block) for s in names], shards, seed)
    until = lambda by: Window.partitionBy("_source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    begins = leaves.select("_source", (F.coalesce(F.sum("_blocks").over(until("shard")), F.lit(0)) * block).alias("_rank"), "shard")
    left = spark.createDataFrame([(s, take.get(s, 0), -1) for s in sizes if take.get(s, 0) < sizes[s]], "_source string, _rank long, shard long")
    begins = begins.unionByName(left)
    # The hashes of the rows that have these ranks are where the shards begin.
    number = F.row_number().over(Window.partitionBy("_source", "_range").orderBy("_hash")) - 1
    before = counts.select("_source", "_range", F.coalesce(F.sum("_n").over(until("_range")), F.lit(0)).alias("_before"))
    ranked = thin.withColumn("_range", span).withColumn("_number", number).join(before, ["_source", "_range"]).withColumn("_rank", F.col("_before") + F.col("_number"))
    bounds = ranked.join(few(settle(left.select("_source", F.col("_rank").alias("_end")))), "_source", "left").where((F.col("_rank") % block == 0) | (F.col("_rank") == F.col("_end")))
    bounds = bounds.select("_source", "_range", "_rank", "_hash").join(begins, ["_source", "_rank"])
    edges = bounds.groupBy("_source", "_range").agg(F.array_sort(F.collect_list(F.struct("_hash", "shard"))).alias("_edges"))
    edges = counts.join(edges, ["_source", "_range"], "left").withColumn("_last", F.element_at("_edges", -1)["shard"])
    plan = settle(edges.select("_source", "_range", F.last("_last", True).over(until("_range")).alias("_first"), "_edges"))
    # Now the texts: a row's shard is that of the last edge before it.
    passed = F.filter("_edges", lambda e: e["_hash"] <= F.col("_hash"))
    shard = F.coalesce(F.try_element_at(passed, F.lit(-1))["shard"], F.col("_first"))
    out = rows.withColumn("_range", span).join(few(plan), ["_source", "_range"]).select("_doc", "_hash", shard.cast("int").alias("shard")).where("shard >= 0")
    local = Window.partitionBy("shard").orderBy(F.xxhash64("_hash", F.lit(seed + 1)), "_hash")
    return out.withColumn("position", F.row_number().over(local).cast("long")).select("_doc.*", "shard", "position")
