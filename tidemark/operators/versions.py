"""Version algebra, compaction, seqno windows, and merges of snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.model import UNBOUNDED, VERSION, Bound, Cutoff, InvalidInput, within


# -- one key's versions -------------------------------------------------------


def latest(versions: DataFrame, *extra: str) -> DataFrame:
    """The version with the greatest seqno of each key, tombstones included."""
    # A maximum for each column: columns of fixed width then fit a hash aggregate's buffers.
    best = [F.max_by(c, "seqno").alias(c) for c in ("value", "deleted", *extra)]
    return versions.groupBy("key").agg(F.max("seqno").alias("seqno"), *best)


def packed(versions: DataFrame) -> DataFrame:
    """One row a key: value struct of the latest version, deltas with the older ones, oldest first."""
    chain = F.array_sort(F.collect_list(F.struct("seqno", "value", "deleted"))).alias("chain")
    older = F.transform(F.slice("chain", 1, F.size("chain") - 1), lambda x: F.struct(x["value"].alias("delta"), x["seqno"].alias("seqno"), x["deleted"].alias("deleted")))
    last = F.element_at("chain", -1)
    return versions.groupBy("key").agg(chain).select("key", F.struct(last["value"].alias("value"), last["seqno"].alias("seqno"), last["deleted"].alias("deleted")).alias("value"), older.alias("deltas"))


def unpacked(entries: DataFrame, merge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """All versions of packed entries.

    merge(newer value, delta) gives the older value where deltas aren't older
    values themselves; it runs from the newest version back.  A delta after a
    tombstone is the value itself.
    """
    as_version = lambda d: F.struct(d["seqno"].alias("seqno"), d["delta"].alias("value"), d["deleted"].alias("deleted"))
    tip = F.struct(F.col("value.seqno").alias("seqno"), F.col("value.value").alias("value"), F.col("value.deleted").alias("deleted"))
    if merge is None:
        chain = F.concat(F.transform("deltas", as_version), F.array(tip))
    else:

        def older(acc: Column, d: Column) -> Column:
            newer = acc[0]
            value = F.when(d["deleted"], F.lit(None)).when(newer["deleted"], d["delta"]).otherwise(merge(newer["value"], d["delta"]))
            return F.concat(F.array(F.struct(d["seqno"].alias("seqno"), value.alias("value"), d["deleted"].alias("deleted"))), acc)

        chain = F.aggregate(F.reverse("deltas"), F.array(tip), older)
    return entries.select("key", F.explode(chain).alias("v")).select("key", "v.seqno", "v.value", "v.deleted")


def encoded(versions: DataFrame, diff: Callable[[Column, Column], Column]) -> DataFrame:
    """Packed entries whose deltas are diff(newer value, older value); beside a tombstone the older value itself."""
    w = Window.partitionBy("key").orderBy("seqno")
    newer = F.lead(F.struct("value", "deleted")).over(w)
    delta = F.when(newer.isNull() | newer["deleted"] | F.col("deleted"), F.col("value")).otherwise(diff(newer["value"], F.col("value")))
    return packed(versions.withColumn("value", delta))


def drain_deltas(entries: DataFrame) -> DataFrame:
    return entries.withColumn("deltas", F.slice("deltas", 1, 0))


def from_values(key: Column, values: Column) -> Column:
    """A packed entry of an array of {seqno, value, deleted}, oldest first; an empty one is an error."""
    chain = F.when(F.size(values) > 0, values).otherwise(F.raise_error(F.lit("an entry needs a version")))
    last = F.element_at(chain, -1)
    older = F.transform(F.slice(chain, 1, F.size(chain) - 1), lambda x: F.struct(x["value"].alias("delta"), x["seqno"].alias("seqno"), x["deleted"].alias("deleted")))
    return F.struct(key.alias("key"), F.struct(last["value"].alias("value"), last["seqno"].alias("seqno"), last["deleted"].alias("deleted")).alias("value"), older.alias("deltas"))


def summary(versions: DataFrame) -> DataFrame:
    """(key, oldest_seqno, seqno, deltas, deleted)."""
    return versions.groupBy("key").agg(F.min("seqno").alias("oldest_seqno"), F.max("seqno").alias("seqno"), (F.count("*") - 1).alias("deltas"), F.max_by("deleted", "seqno").alias("deleted"))


def newest_first(versions: DataFrame) -> DataFrame:
    """All versions with age: 0 for the latest, 1 for the one before."""
    return versions.withColumn("age", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seqno"))) - 1)


def lacking(versions: DataFrame, other: DataFrame) -> DataFrame:
    """Versions of other that aren't in versions."""
    same = [versions[c].eqNullSafe(other[c]) for c in VERSION]
    return other.join(versions, same, "left_anti")


def contains(versions: DataFrame, other: DataFrame) -> bool:
    return lacking(versions, other).isEmpty()


# -- compaction ---------------------------------------------------------------


def compact(versions: DataFrame, cutoff: Cutoff) -> DataFrame:
    """What a cutoff leaves.  Only mono and tombstone need to know a key's latest version; lsm is a filter that reaches the scan."""
    if cutoff.noop:
        return versions
    if cutoff.kind == "lsm":
        return versions.where(~within(F.col("seqno"), high=cutoff.bound))
    if cutoff.kind == "mono":
        return latest(versions).where(~F.col("deleted"))
    tip = F.max_by(F.struct("seqno", "deleted"), "seqno").over(Window.partitionBy("key"))
    marked = versions.withColumn("tip", tip)
    return marked.where(~(F.col("tip.deleted") & within(F.col("tip.seqno"), high=cutoff.bound))).select(VERSION)


# -- seqno windows ------------------------------------------------------------


def seqno_window(versions: DataFrame, low: Bound = UNBOUNDED, high: Bound = UNBOUNDED) -> DataFrame:
    """Versions within; to be taken before the latest is, as it decides which that is."""
    return versions.where(within(F.col("seqno"), low, high))


def as_of(versions: DataFrame, seqno: int) -> DataFrame:
    """The latest version of each key at a seqno."""
    return latest(seqno_window(versions, high=Bound("included", seqno)))


def scan_within(tables: Sequence[DataFrame], low: Bound = UNBOUNDED, high: Bound = UNBOUNDED) -> DataFrame:
    """Versions of several tables within a window of seqnos."""
    return seqno_window(reduce(DataFrame.unionByName, [t.select(VERSION) for t in tables]), low, high)


def page(table: DataFrame, after=None, size: int = 1000) -> DataFrame:
    """The next rows by key: a scan that can be taken up again."""
    rows = table if after is None else table.where(F.col("key") > F.lit(after))
    return rows.orderBy("key").limit(size)


# -- merges -------------------------------------------------------------------


def merge(newer: DataFrame, older: DataFrame, versions: bool = True) -> DataFrame:
    """A newer snapshot over an older one; without versions, the older one's history is dropped first."""
    base = older if versions else latest(older)
    return newer.select(VERSION).unionByName(base.select(VERSION))


def interleave(one: DataFrame, other: DataFrame) -> DataFrame:
    """Histories of both in the order of seqnos, which may alternate."""
    return one.select(VERSION).unionByName(other.select(VERSION))


def append(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Histories joined where all of a key's newer versions come after the older ones; else InvalidInput."""
    ends = newer.groupBy("key").agg(F.min("seqno").alias("begin")).join(older.groupBy("key").agg(F.max("seqno").alias("end")), "key")
    bad = ends.where("begin <= end").first()
    if bad is not None:
        raise InvalidInput(f"versions of key {bad['key']!r} overlap")
    return interleave(newer, older)


def levels(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables from the newest level (0) to the oldest, with their level."""
    return reduce(DataFrame.unionByName, [t.select(*VERSION, F.lit(k).alias("level")) for k, t in enumerate(tables)])


def _best(tables: Sequence[DataFrame], order: Column) -> DataFrame:
    """The row of each key that comes first in an order, given as one number so that a hash aggregate holds it."""
    rows = levels(tables).withColumn("_order", order.cast("decimal(38,0)"))
    return rows.groupBy("key").agg(*[F.max_by(c, "_order").alias(c) for c in ("seqno", "value", "deleted")])


def level_winner(tables: Sequence[DataFrame]) -> DataFrame:
    """The latest version over all levels; at equal seqnos that of the newer level."""
    return _best(tables, F.col("seqno").cast("decimal(25,0)") * len(tables) - F.col("level"))


def first_level(tables: Sequence[DataFrame]) -> DataFrame:
    """The version of the first level that has the key, whatever its seqno."""
    return _best(tables, F.lit("100000000000000000000").cast("decimal(21,0)") * (len(tables) - F.col("level")) + F.col("seqno"))
