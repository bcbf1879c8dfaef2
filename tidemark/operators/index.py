"""Ordered reads over a versioned table, and the table as an object that reads, writes and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.model import UNBOUNDED, VERSION, Bound, Cutoff, KeyNotFound, NotSupported, TableError, within

from . import oplog
from . import versions as V

_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}

#: Rows that are listed at once.
_BLOCK = 10_000


def width(column: str, kind: T.DataType) -> Column:
    """Bytes of a value: fixed by type, or its own length; an array's elements are counted at eight bytes."""
    if type(kind) in _WIDTH:
        return F.lit(_WIDTH[type(kind)])
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(column) * 8, F.lit(0))
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0))


def footprint(versions: DataFrame) -> Column:
    """Bytes of a version: key, value, seqno and flag."""
    kinds = {f.name: f.dataType for f in versions.schema}
    return width("key", kinds["key"]) + F.when(F.col("deleted"), 0).otherwise(width("value", kinds["value"])) + 9


def ordered(rows: DataFrame, reverse: bool = False) -> DataFrame:
    """By key, and each key's versions from the oldest."""
    by = [F.desc("key") if reverse else F.asc("key")]
    return rows.orderBy(*by, *(["seqno"] if "seqno" in rows.columns else []))


def get(versions: DataFrame, key) -> DataFrame:
    return V.latest(versions.where(F.col("key") == F.lit(key)))


def get_versions(versions: DataFrame, key) -> DataFrame:
    return versions.where(F.col("key") == F.lit(key))


def scan(versions: DataFrame, low: Bound = UNBOUNDED, high: Bound = UNBOUNDED, reverse: bool = False, history: bool = False, live_only: bool = False) -> DataFrame:
    """A range of keys in order.  The bounds are below the grouping, so that they reach the scan; tombstones are rows unless live_only."""
    rows = versions.where(within(F.col("key"), low, high))
    rows = rows if history else V.latest(rows)
    return ordered(rows.where(~F.col("deleted")) if live_only else rows, reverse)


def stats(versions: DataFrame) -> DataFrame:
    """One row: n_count (keys, tombstoned ones too), n_deleted, seqno, n_versions, footprint."""
    each = versions.withColumn("bytes", footprint(versions)).groupBy("key").agg(F.max_by("deleted", "seqno").alias("gone"), F.max("seqno").alias("tip"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return each.agg(F.count("*").alias("n_count"), F.coalesce(F.sum(F.col("gone").cast("long")), F.lit(0)).alias("n_deleted"), F.coalesce(F.max("tip"), F.lit(0)).alias("seqno"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_versions"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("footprint"))


def violations(versions: DataFrame, seqno: int | None = None) -> DataFrame:
    """(key, seqno, problem) of rows that no table may have: a seqno twice or below 1, a tombstone with a value, a seqno beyond the table's.

    The table is gone through once: a union of two readings of it would compute both,
    with their sorts, in the same tasks.  Rows are counted by seqno, so that many
    repeated ones are summed up where they are read, and listed again in blocks.
    """
    n, valued = F.col("n"), F.col("valued")
    own = F.when(F.col("key").isNull(), "no key").when(F.col("seqno").isNull() | (F.col("seqno") < 1), "seqno below 1")
    kinds = [(F.lit("repeated seqno"), F.when(n > 1, 1)), (own, F.when(own.isNotNull(), n)), (F.lit("tombstone with a value"), F.when(own.isNull(), valued))]
    if seqno is not None:
        kinds.append((F.lit("seqno beyond the table's"), F.when(own.isNull() & (F.col("seqno") > seqno), n - valued)))
    each = versions.groupBy("key", "seqno").agg(F.count("*").alias("n"), F.count_if(F.col("deleted") & F.col("value").isNotNull()).alias("valued"))
    found = each.select("key", "seqno", F.explode(F.array(*[F.struct(problem.alias("problem"), times.cast("long").alias("times")) for problem, times in kinds])).alias("p")).select("key", "seqno", "p.*").where("times > 0")
    blocks = found.withColumn("block", F.explode(F.expr(f"sequence(0L, (times - 1) div {_BLOCK})")))
    return blocks.select("key", "seqno", F.explode(F.expr(f"array_repeat(problem, int(least({_BLOCK}, times - block * {_BLOCK})))")).alias("problem"))


class Index:
    """A named table.  Each write gives a new table; the old one stays as it was, so a reader's view never changes."""

    def __init__(self, name: str, versions: DataFrame, read_only: bool = False, seqno: int | None = None, metadata: bytes = b""):
        self.name, self.versions, self.read_only, self.metadata = name, versions.select(VERSION), read_only, metadata
        self._seqno = seqno

    @classmethod
    def empty(cls, name: str, spark, key: T.DataType | None = None, value: T.DataType | None = None) -> Index:
        from tidemark.plans.model import version_schema

        return cls(name, spark.createDataFrame([], version_schema(key, value)))

    def _new(self, versions: DataFrame, seqno: int | None = None) -> Index:
        return Index(self.name, versions, self.read_only, seqno, self.metadata)

    def clone(self) -> Index:
        return self._new(self.versions, self._seqno)

    # reads
    def get(self, key, history: bool = False):
        """The key's latest version as a row, or all of them; KeyNotFound without any. A tombstone is found."""
        rows = get_versions(self.versions, key).orderBy("seqno").collect() if history else get(self.versions, key).collect()
        if not rows:
            raise KeyNotFound(key)
        return rows if history else rows[0]

    def get_versions(self, key):
        return self.get(key, history=True)

    def iter(self) -> DataFrame:
        return scan(self.versions)

    def iter_versions(self) -> DataFrame:
        return scan(self.versions, history=True)

    def range(self, low: Bound = UNBOUNDED, high: Bound = UNBOUNDED) -> DataFrame:
        return scan(self.versions, low, high)

    def range_versions(self, low: Bound = UNBOUNDED, high: Bound = UNBOUNDED) -> DataFrame:
        return scan(self.versions, low, high, history=True)

    def reverse(self, low: Bound = UNBOUNDED, high: Bound = UNBOUNDED) -> DataFrame:
        return scan(self.versions, low, high, reverse=True)

    def reverse_versions(self, low: Bound = UNBOUNDED, high: Bound = UNBOUNDED) -> DataFrame:
        return scan(self.versions, low, high, reverse=True, history=True)

    def first(self):
        rows = scan(self.versions).limit(1).collect()
        return rows[0] if rows else None

    def last(self):
        rows = scan(self.versions, reverse=True).limit(1).collect()
        return rows[0] if rows else None

    # counts
    def __len__(self) -> int:
        return self.versions.select("key").distinct().count()

    def is_empty(self) -> bool:
        return self.versions.isEmpty()

    def stats(self) -> DataFrame:
        return stats(self.versions)

    def deleted_count(self) -> int:
        return self.stats().first()["n_deleted"]

    def to_seqno(self) -> int:
        return max(self._seqno or 0, self.versions.agg(F.coalesce(F.max("seqno"), F.lit(0))).first()[0])

    def set_seqno(self, seqno: int) -> Index:
        return self._new(self.versions, seqno)

    def footprint(self) -> int:
        return self.stats().first()["footprint"]

    def to_json(self) -> str:
        return self.stats().select(F.to_json(F.struct(F.lit(self.name).alias("name"), "*"))).first()[0]

    def validate(self) -> None:
        bad = violations(self.versions, self._seqno).first()
        if bad is not None:
            raise TableError(f"{self.name}: {bad['problem']} at key {bad['key']!r}")

    def show(self, n: int = 20) -> None:
        ordered(self.versions).show(n, truncate=False)

    # writes
    def _writable(self) -> None:
        if self.read_only:
            raise NotSupported(f"{self.name} is a snapshot and can't be written to")

    def write(self, mutations: DataFrame) -> Index:
        """The table after mutations with their own seqnos (newer than the table's), failed compare-and-sets skipped."""
        self._writable()
        base = self.versions.select("seqno", F.when(F.col("deleted"), "delete").otherwise("insert").alias("op"), "key", "value", F.lit(None).cast("long").alias("cas"))
        log = base.unionByName(mutations.select("seqno", "op", "key", "value", "cas"))
        return self._new(oplog.cas_fold(log) if not mutations.where("cas IS NOT NULL").isEmpty() else oplog.fold(log))

    def commit(self, batch: DataFrame, versions: bool = True) -> Index:
        self._writable()
        oplog.check_commit(self.versions, batch)
        return self._new(oplog.commit(self.versions, batch, versions))

    def compact(self, cutoff: Cutoff) -> Index:
        return self._new(V.compact(self.versions, cutoff), self._seqno)

    def merged_under(self, newer: DataFrame, versions: bool = True) -> DataFrame:
        return V.merge(newer, self.versions, versions)

    def close(self) -> None:
        self.versions.unpersist()


def write_one(index: Index, spark, op: str, key, value=None, cas: int | None = None) -> tuple[Index, int, object]:
    """One write with the next seqno: (table, seqno, version before); raises InvalidCAS."""
    index._writable()
    model = oplog.Model(index.to_seqno())
    rows = get_versions(index.versions, key).orderBy("seqno").collect()
    if rows:
        model.entries[key] = [(r["seqno"], r["value"], r["deleted"]) for r in rows]
    old = model.apply(op, key, value, cas)
    rest = index.versions.where(F.col("key") != F.lit(key))
    changed = spark.createDataFrame(model.rows(), index.versions.schema)
    return index._new(rest.unionByName(changed), model.seqno), model.seqno, old
