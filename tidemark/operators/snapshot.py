"""Immutable snapshots on disk: range-partitioned, sorted Parquet with a sidecar of metadata."""

from __future__ import annotations

import base64
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.model import VERSION, Cutoff, InvalidFile, InvalidInput
from tidemark.session import ready, settle

from . import index as I
from . import membership
from . import versions as V
from .shards import as_shards

MARKER = "versioned snapshot 2"
#: Keys of a filter, about.
KEYS = 1 << 22


@dataclass
class Config:
    """delta_ok keeps history; files is how many sorted files are written, None for the session's number of partitions; filter is a kind of filter over the keys."""

    name: str
    delta_ok: bool = True
    files: int | None = None
    row_group_bytes: int = 128 << 20
    page_bytes: int = 1 << 20
    filter: str = "none"

    def to_stats(self) -> dict:
        return asdict(self)


@dataclass
class Snapshot:
    path: str
    config: Config
    stats: dict = field(default_factory=dict)
    metadata: bytes = b""

    def _fs(self, spark: SparkSession, part: str = ""):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path + part)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/data").select(VERSION)

    def index(self, spark: SparkSession) -> I.Index:
        return I.Index(self.config.name, self.table(spark), True, self.stats.get("seqno"), self.metadata)

    def is_compacted(self) -> bool:
        return bool(self.stats.get("compacted"))

    def footprint(self, spark: SparkSession) -> int:
        fs, path = self._fs(spark)
        return fs.getContentSummary(path).getLength()

    def files(self, spark: SparkSession) -> list[str]:
        """The sorted files, in the order of their keys."""
        ends = self._files(spark).groupBy("file").agg(F.min("key").alias("lo"))
        return [r["file"] for r in ends.orderBy("lo").collect()]

    def __len__(self) -> int:
        return self.stats["n_count"]

    def filters(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/filter")

    def get(self, spark: SparkSession, key) -> DataFrame:
        """The latest version of a key; the filter is asked first, so that a key that it excludes costs no read of data."""
        table = self.table(spark)
        return self.get_all(spark, spark.createDataFrame([(key,)], T.StructType([table.schema["key"]])))

    def get_all(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        """The latest versions of many keys (key): those that pass the filter are joined."""
        wanted = keys.select("key").distinct()
        if self.config.filter != "none":
            named = wanted.withColumn("digest", F.xxhash64("key"))
            wanted = named.join(membership.maybe(named, self.filters(spark)), "digest", "left_semi").select("key")
            if wanted.isEmpty():
                return self.table(spark).limit(0)
        return V.latest(self.table(spark).join(wanted, "key", "left_semi"))

    def _files(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/data").select("key", "seqno", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def validate(self, spark: SparkSession) -> None:
        """Counts and seqnos as the sidecar has them, files sorted and apart, no row that no table may have, and no key that the filter lacks."""
        have = I.stats(self.table(spark)).first()
        for k in ("n_count", "n_deleted", "n_versions", "footprint"):
            if have[k] != self.stats[k]:
                raise InvalidFile(f"{k} is {have[k]}, the sidecar has {self.stats[k]}")
        if have["seqno"] > self.stats["seqno"]:
            raise InvalidFile("a seqno is beyond the snapshot's")
        I.Index(self.config.name, self.table(spark), seqno=self.stats["seqno"]).validate()
        # In a file rows are numbered, so the one before is known without sorting by key.
        before = F.lag(F.struct("key", "seqno")).over(Window.partitionBy("file").orderBy("row"))
        bad = self._files(spark).withColumn("before", before).where(F.col("before").isNotNull() & (F.struct("key", "seqno") <= F.col("before"))).first()
        if bad is not None:
            raise InvalidFile(f"key {bad['key']!r} at {bad['seqno']} isn't in order in {bad['file']}")
        ends = self._files(spark).groupBy("file").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        # One row a file.
        bad = ends.withColumn("last", F.max("hi").over(Window.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))).where("lo <= last").first()
        if bad is not None:
            raise InvalidFile(f"{bad['file']} has keys of another file")
        if self.config.filter != "none":
            named = self.table(spark).select(F.xxhash64("key").alias("digest")).distinct()
            if not named.join(membership.maybe(named, self.filters(spark)), "digest", "left_anti").isEmpty():
                raise InvalidFile("the filter lacks a key")

    def lock(self, spark: SparkSession) -> Callable[[], None]:
        """Marks the snapshot as in use; the result unlocks it."""
        fs, path = self._fs(spark, f"/locks/{uuid.uuid4().hex}")
        fs.create(path).close()
        return lambda: fs.delete(path, False)

    def purge(self, spark: SparkSession) -> None:
        """Deletes the snapshot; InvalidInput while it is in use."""
        fs, path = self._fs(spark, "/locks")
        if fs.exists(path) and len(fs.listStatus(path)):
            raise InvalidInput(f"{self.path} is in use")
        fs, path = self._fs(spark)
        fs.delete(path, True)


def _sidecar(spark: SparkSession, s: Snapshot) -> None:
    body = {"marker": MARKER, "config": s.config.to_stats(), "stats": s.stats, "metadata": base64.b64encode(s.metadata).decode()}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{s.path}/meta")


def build(versions: DataFrame, path: str, config: Config, seqno: int = 0, metadata: bytes = b"", compacted: bool = False) -> Snapshot:
    """A new snapshot of a table; its seqno is the greatest of the rows' and the given one.

    Keys are range-partitioned and sorted within files, so that a range of keys
    reads few row groups; a snapshot is never changed afterwards.  Counts are
    observed while it is written: a key's rows follow each other, so its last one is known there.
    """
    spark = ready(versions.sparkSession)
    began = time.time()
    rows = versions.select(VERSION) if config.delta_ok else V.latest(versions)
    parts = [config.files] if config.files else []
    ordered = rows.repartitionByRange(*parts, "key").sortWithinPartitions("key", "seqno")
    tip = F.lead("seqno").over(Window.partitionBy("key").orderBy("seqno")).isNull()
    seen = Observation()
    counted = ordered.withColumns({"_tip": tip, "_bytes": I.footprint(rows)}).observe(
        seen, F.count_if("_tip").alias("n_count"), F.count_if(F.col("_tip") & F.col("deleted")).alias("n_deleted"), F.coalesce(F.max("seqno"), F.lit(0)).alias("seqno"),
        F.count(F.lit(1)).alias("n_versions"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("footprint"),
    )
    counted.select(VERSION).write.mode("errorifexists").option("parquet.block.size", config.row_group_bytes).option("parquet.page.size", config.page_bytes).parquet(f"{path}/data")
    s = dict(seen.get)
    if config.filter != "none":
        keys = spark.read.parquet(f"{path}/data").select(F.xxhash64("key").alias("digest"))
        membership.filters(keys, config.filter, max(1, -(-s["n_count"] // KEYS))).write.parquet(f"{path}/filter")
    s |= {"seqno": max(s["seqno"], seqno), "build_ms": int((time.time() - began) * 1000), "epoch_ns": time.time_ns(), "compacted": compacted}
    out = Snapshot(path, config, s, metadata)
    _sidecar(spark, out)
    return out


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    try:
        body = json.loads(spark.read.text(f"{path}/meta").first()[0])
    except Exception as e:
        raise InvalidFile(f"{path} has no sidecar") from e
    if body.get("marker") != MARKER:
        raise InvalidFile(f"{path} is marked {body.get('marker')!r}")
    return Snapshot(path, Config(**body["config"]), body["stats"], base64.b64decode(body["metadata"]))


def incremental(spark: SparkSession, older: Snapshot, newer: DataFrame, path: str, versions: bool = True, metadata: bytes | None = None) -> Snapshot:
    """The next snapshot: a newer batch merged over an older snapshot."""
    if path == older.path:
        raise InvalidInput("a snapshot can't be written over itself")
    merged = V.merge(newer, older.table(spark), versions)
    return build(merged, path, older.config, older.stats["seqno"], older.metadata if metadata is None else metadata)


def compact(spark: SparkSession, older: Snapshot, path: str, cutoff: Cutoff) -> Snapshot:
    return build(V.compact(older.table(spark), cutoff), path, older.config, older.stats["seqno"], older.metadata, compacted=True)


# -- several levels --


class Levels:
    """Snapshots from the newest level to the oldest, with the policies that say when to flush and to compact."""

    LEVELS, RATIO = 16, 0.5

    def __init__(self, tables: list[DataFrame], sizes: list[int] | None = None, lsm: bool = True):
        self.tables, self.sizes, self.lsm = tables, sizes or [0] * len(tables), lsm

    def get(self, key) -> DataFrame:
        return V.first_level([t.where(F.col("key") == F.lit(key)) for t in self.tables])

    def get_versions(self, key) -> DataFrame:
        return V.scan_within([t.where(F.col("key") == F.lit(key)) for t in self.tables])

    def iter(self, reverse: bool = False) -> DataFrame:
        return I.ordered(V.level_winner(self.tables), reverse)

    def iter_versions(self, reverse: bool = False) -> DataFrame:
        return I.ordered(V.scan_within(self.tables), reverse)

    @classmethod
    def commit_level(cls, memory: int, sizes: list[int | None]) -> int:
        """Where a flush goes: the newest level in use is rewritten if memory is at least RATIO of it, else the one before it is used."""
        used = [k for k, s in enumerate(sizes) if s is not None]
        if not used:
            return len(sizes) - 1
        first = used[0]
        return first if first == 0 or memory >= cls.RATIO * sizes[first] else first - 1

    @classmethod
    def compact_levels(cls, sizes: list[int | None]) -> tuple[list[int], int] | None:
        """(levels to merge, level to write): the first one that is at least RATIO of the next in use."""
        used = [k for k, s in enumerate(sizes) if s is not None]
        for a, b in zip(used[:-1], used[1:]):
            if sizes[a] >= cls.RATIO * sizes[b]:
                return [a, b], b
        return None

    def cutoff(self, last: bool, turn: int, seqno: int) -> Cutoff | None:
        """What a compaction may drop: only the last level may lose anything; with lsm tombstones and old versions take turns."""
        if not last:
            return None
        if not self.lsm:
            return Cutoff("mono")
        from tidemark.plans.model import included

        return Cutoff("tombstone" if turn % 2 == 0 else "lsm", included(seqno))


class Tree:
    """A table as a log-structured tree: writes go to memory, which is flushed to levels of snapshots that are merged as they grow.

    Level 0 is the newest.  A flush and a merge write a new snapshot and drop the
    old ones after it; what readers hold stays as it was until then.  Only a merge
    that writes the oldest level may lose versions.
    """

    def __init__(self, spark: SparkSession, folder: str, config: Config, key: T.DataType | None = None, value: T.DataType | None = None, lsm: bool = True):
        self.spark, self.folder, self.config, self.lsm = spark, folder, config, lsm
        self.memory = I.Index.empty(config.name, spark, key, value)
        self.empty = self.memory
        self.levels: list[Snapshot | None] = [None] * Levels.LEVELS
        self.turn = 0

    def _new(self, level: int) -> str:
        self.turn += 1
        return f"{self.folder}/{self.config.name}-{level:02d}-{self.turn:06d}"

    def sizes(self) -> list[int | None]:
        return [None if s is None else s.stats["footprint"] for s in self.levels]

    def tables(self) -> list[DataFrame]:
        """Memory, then levels from the newest."""
        return [self.memory.versions, *[s.table(self.spark) for s in self.levels if s is not None]]

    def read(self) -> Levels:
        return Levels(self.tables(), lsm=self.lsm)

    def write(self, batch: DataFrame) -> None:
        """Versions newer than all that are there."""
        self.memory = self.memory.commit(batch)

    def flush(self) -> int | None:
        """Memory to disk: into the newest level, or before it where memory is small beside it. The level written, None for empty memory."""
        rows = settle(self.memory.versions)
        size = I.stats(rows).first()
        if not size["n_versions"]:
            return None
        at = Levels.commit_level(size["footprint"], self.sizes())
        old = self.levels[at]
        self.levels[at] = build(rows, self._new(at), self.config) if old is None else incremental(self.spark, old, rows, self._new(at), self.config.delta_ok)
        if old is not None:
            old.purge(self.spark)
        self.memory = self.empty
        return at

    def compact(self, cutoff: Cutoff | None = None) -> int | None:
        """Merges the first two levels that are near in size; the cutoff applies where the oldest level is written. The level written, or None."""
        todo = Levels.compact_levels(self.sizes())
        if todo is None:
            return None
        (newer, older), at = todo
        one, other = self.levels[newer], self.levels[older]
        merged = V.merge(one.table(self.spark), other.table(self.spark), self.config.delta_ok)
        last = all(s is None for s in self.levels[older + 1 :])
        if cutoff is not None and last:
            merged = V.compact(merged, cutoff)
        self.levels[at] = build(merged, self._new(at), self.config, max(one.stats["seqno"], other.stats["seqno"]), compacted=cutoff is not None and last)
        self.levels[newer] = None
        one.purge(self.spark)
        other.purge(self.spark)
        return at


def reshard(spark: SparkSession, shards: list[Snapshot], folder: str) -> list[Snapshot]:
    """As many shards of a table of equal numbers of keys: new snapshots if any is far from the mean, else the same."""
    if not rebalance([s.stats["n_count"] for s in shards]):
        return shards
    every = V.scan_within([s.table(spark) for s in shards])
    placed = settle(as_shards(every.select("key").distinct(), len(shards)))
    ends = placed.groupBy("shard").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("shard").collect()
    return [build(every.where(F.col("key").between(r["lo"], r["hi"])), f"{folder}/{r['shard']:04d}", shards[r["shard"]].config) for r in ends]


def advance(old: Cutoff | None, new: Cutoff, tip: int) -> Cutoff:
    """A cutoff only moves forward; an unbounded one means the tip."""
    from tidemark.plans.model import included

    if new.kind == "mono":
        return new
    if new.bound.kind == "unbounded":
        new = Cutoff(new.kind, included(tip))
    if old is None or old.kind != new.kind:
        return new
    last = lambda c: c.bound.at - (c.bound.kind == "excluded")
    if last(new) < last(old):
        raise InvalidInput("a cutoff can't move back")
    return new


def rebalance(sizes: list[int], low: float = 0.5, high: float = 1.5) -> list[int]:
    """Shards that are far from the mean size."""
    mean = sum(sizes) / len(sizes) if sizes else 0
    return [k for k, s in enumerate(sizes) if mean and not low * mean <= s <= high * mean]
