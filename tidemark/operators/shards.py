"""Shards and partitions of ordered rows, and a cache model."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.model import Bound, InvalidInput, excluded, included, within
from tidemark.session import ready, settle


def running(rows: DataFrame, by: Sequence[Column | str], **amounts: Column) -> DataFrame:
    """rows with running totals of amounts in the given order, their own included; equal rows in it come in any order.

    Rows are range-partitioned once and settled; a total is that of the partitions
    before and of the rows before in the own one, so no task sees all rows.
    """
    placed = settle(rows.withColumns({f"_own_{k}": v for k, v in amounts.items()}).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part").agg(*[F.sum(f"_own_{k}").alias(f"_sum_{k}") for k in amounts])
    # One row a partition.
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *[F.coalesce(F.sum(f"_sum_{k}").over(over), F.lit(0)).alias(f"_start_{k}") for k in amounts])
    within_ = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({k: F.sum(f"_own_{k}").over(within_) for k in amounts}).join(F.broadcast(starts), "_part")
    return out.withColumns({k: F.col(k) + F.col(f"_start_{k}") for k in amounts}).drop("_part", *[f"_{x}_{k}" for k in amounts for x in ("own", "start")])


def as_shards(rows: DataFrame, n: int, by: str = "key") -> DataFrame:
    """rows with shard 0..n-1: n runs of the ordered rows whose sizes differ by one at most, larger ones first: exact ntile without a sort of all rows in one task."""
    if n <= 0:
        return rows.withColumn("shard", F.lit(0)).limit(0)
    out = running(rows, [by], _at=F.lit(1).cast("long")).withColumn("_at", F.col("_at") - 1)
    total = out.agg(F.count("*")).first()[0]
    small, more = divmod(total, n)
    # The first rows % n shards have one row more.
    edge = more * (small + 1)
    shard = F.when(F.col("_at") < edge, F.floor(F.col("_at") / (small + 1))).otherwise(more + F.floor((F.col("_at") - edge) / max(small, 1)))
    return out.withColumn("shard", shard.cast("int")).drop("_at")


def by_ranges(column: Column, ranges: Sequence[tuple[Bound, Bound]]) -> Column:
    """The number of the first range that has the value, or null."""
    out = F.lit(None).cast("int")
    for k, (low, high) in reversed(list(enumerate(ranges))):
        out = F.when(within(column, low, high), F.lit(k)).otherwise(out)
    return out


def high_keys_to_ranges(highs: Sequence[Bound]) -> list[tuple[Bound, Bound]]:
    """Ranges that end at the given bounds, in order; each begins where the one before ends."""
    out, low = [], Bound()
    for high in highs:
        if high.kind == "included":
            raise InvalidInput("a range ends before its high key")
        out.append((low, high))
        low = high_to_low(high)
    return out


def high_to_low(high: Bound) -> Bound:
    return included(high.at) if high.kind == "excluded" else Bound()


def to_start_end(low: int | None, high: int | None) -> tuple[Bound, Bound]:
    return (Bound() if low is None else included(low), Bound() if high is None else excluded(high))


def split(rows: DataFrame, pivot) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("key") < F.lit(pivot)), rows.where(F.col("key") >= F.lit(pivot))


def hashed(rows: DataFrame, n: int, column: str = "key") -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.col(column), F.lit(n)).cast("int"))


def keep_recent(accesses: DataFrame, most: int, key: str = "key", at: str = "at", order: str = "seq") -> DataFrame:
    """The keys that a least-recently-used cache of so many holds after a trace: those accessed last."""
    last = accesses.groupBy(key).agg(F.max(F.struct(at, order)).alias("last"))
    return last.orderBy(F.desc("last")).limit(most).select(key, F.col(f"last.{at}").alias(at), F.col(f"last.{order}").alias(order))


def evicted(entries: DataFrame, most: int, bytes_most: int, now, oldest_s: int) -> DataFrame:
    """Entries (key, last_access, size, deleted) that a cache drops: deleted ones, too many, too large in sum, or too old."""
    recent = running(entries.where("NOT deleted"), [F.desc("last_access"), F.asc("key")], n=F.lit(1).cast("long"), bytes=F.col("size"))
    old = F.col("last_access").cast("timestamp").cast("long") < F.lit(now).cast("timestamp").cast("long") - oldest_s
    out = recent.where((F.col("n") > most) | (F.col("bytes") > bytes_most) | old)
    return out.select("key").union(entries.where("deleted").select("key"))


def cache_stats(trace: DataFrame, most: int, key: str = "key", order: str = "seq", op: str = "op") -> DataFrame:
    """One row (gets, sets, deleted, evicted, hits): what a cache of the keys accessed last counts over a trace of get, set and delete.

    A cache's state depends on all accesses in turn, so one task follows the trace,
    holding no more than the cache.
    """

    def run(batches):
        held: OrderedDict = OrderedDict()
        n = {"gets": 0, "sets": 0, "deleted": 0, "evicted": 0, "hits": 0}
        for b in batches:
            for k, what in zip(b.column("_key").to_pylist(), b.column("_op").to_pylist()):
                if what == "get":
                    n["gets"] += 1
                    if k in held:
                        n["hits"] += 1
                        held.move_to_end(k)
                elif what == "set":
                    n["sets"] += 1
                    held[k] = True
                    held.move_to_end(k)
                    if len(held) > most:
                        held.popitem(last=False)
                        n["evicted"] += 1
                elif k in held:
                    del held[k]
                    n["deleted"] += 1
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in n.values()], names=list(n))

    ready(trace.sparkSession)
    rows = trace.select(F.col(key).alias("_key"), F.col(op).alias("_op"), F.col(order).alias("_order")).repartition(1).sortWithinPartitions("_order")
    return rows.mapInArrow(run, "gets long, sets long, deleted long, evicted long, hits long")
