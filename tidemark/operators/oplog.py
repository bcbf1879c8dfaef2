"""Mutations folded into versions: set, insert, delete, remove, compare-and-set, bulk commits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.plans.model import VERSION, InvalidCAS, InvalidInput
from tidemark.session import partitions, ready

from .shards import running


def from_events(events: DataFrame) -> DataFrame:
    """The event log as mutations: signup sets, purchase and click insert, view deletes, error removes."""
    op = F.when(F.col("event_type") == "signup", "set").when(F.col("event_type") == "view", "delete").when(F.col("event_type") == "error", "remove").otherwise("insert")
    return events.select((F.col("event_id") + 1).alias("seqno"), op.alias("op"), F.col("user_id").alias("key"), F.col("value"), F.lit(None).cast("long").alias("cas"))


def _write(spark: SparkSession, op: str, key, value, cas: int | None, seqno: int | None) -> DataFrame:
    kind = T.StringType() if isinstance(key, str) else T.BinaryType() if isinstance(key, bytes) else T.LongType()
    number = T.StringType() if isinstance(value, str) else T.BinaryType() if isinstance(value, bytes) else T.DoubleType() if isinstance(value, float) else T.LongType()
    schema = T.StructType([T.StructField("seqno", T.LongType()), T.StructField("op", T.StringType()), T.StructField("key", kind), T.StructField("value", number), T.StructField("cas", T.LongType())])
    return spark.createDataFrame([(seqno, op, key, value, cas)], schema)


def write_set(spark: SparkSession, key, value, cas: int | None = None, seqno: int | None = None) -> DataFrame:
    return _write(spark, "set", key, value, cas, seqno)


def write_insert(spark: SparkSession, key, value, cas: int | None = None, seqno: int | None = None) -> DataFrame:
    return _write(spark, "insert", key, value, cas, seqno)


def write_delete(spark: SparkSession, key, cas: int | None = None, seqno: int | None = None) -> DataFrame:
    return _write(spark, "delete", key, None, cas, seqno)


def write_remove(spark: SparkSession, key, cas: int | None = None, seqno: int | None = None) -> DataFrame:
    return _write(spark, "remove", key, None, cas, seqno)


def set_seqno(mutations: DataFrame, seqno: int) -> DataFrame:
    return mutations.withColumn("seqno", F.lit(seqno).cast("long"))


def set_cas(mutations: DataFrame, cas: int) -> DataFrame:
    return mutations.withColumn("cas", F.lit(cas).cast("long"))


def as_version(mutations: DataFrame) -> DataFrame:
    """Mutations, none of them a remove, as version rows."""
    gone = F.col("op") == "delete"
    return mutations.select("key", "seqno", F.when(~gone, F.col("value")).alias("value"), gone.alias("deleted"))


def fold(mutations: DataFrame) -> DataFrame:
    """All versions that a log of mutations with their own seqnos leaves.

    A set drops the versions before it and a remove these and itself.  One
    shuffle by key; reads that group by key after it need no other.
    """
    last = lambda op: F.coalesce(F.max(F.when(F.col("op") == op, F.col("seqno"))).over(Window.partitionBy("key")), F.lit(0))
    marked = mutations.withColumns({"last_set": last("set"), "last_remove": last("remove")})
    return as_version(marked.where((F.col("op") != "remove") & (F.col("seqno") >= F.col("last_set")) & (F.col("seqno") > F.col("last_remove"))))


def fold_latest(mutations: DataFrame) -> DataFrame:
    """The latest version of each key straight from the log: its last mutation, unless that removes it.

    Values of fixed width, and the operation as a number, fit the buffers of a hash
    aggregate, so that neither a window nor a sort is needed where history isn't;
    strings are aggregated by sort.
    """
    code = F.when(F.col("op") == "remove", 2).when(F.col("op") == "delete", 1).otherwise(0)
    latest = mutations.groupBy("key").agg(F.max("seqno").alias("seqno"), F.max_by("value", "seqno").alias("value"), F.max_by(code, "seqno").alias("code"))
    gone = F.col("code") == 1
    return latest.where("code < 2").select("key", "seqno", F.when(~gone, F.col("value")).alias("value"), gone.alias("deleted"))


def old_entries(mutations: DataFrame) -> DataFrame:
    """Each mutation with the version that its key had before: old_seqno, old_value, old_deleted, null where it had none."""
    w = Window.partitionBy("key").orderBy("seqno")
    before = F.lag(F.struct("seqno", "value", "op")).over(w)
    had = before.isNotNull() & (before["op"] != "remove")
    marked = mutations.withColumn("before", F.when(had, before))
    gone = F.col("before.op") == "delete"
    return marked.select("seqno", "op", "key", F.col("before.seqno").alias("old_seqno"), F.when(~gone, F.col("before.value")).alias("old_value"), gone.alias("old_deleted"))


class Model:
    """The sequential meaning of mutations, for compare-and-set folds and as a test oracle: key -> versions, oldest first."""

    def __init__(self, seqno: int = 0):
        self.seqno, self.entries = seqno, {}

    def apply(self, op: str, key, value=None, cas: int | None = None, seqno: int | None = None):
        """The version before, or None; raises InvalidCAS and changes nothing if cas isn't the key's seqno (0 for none)."""
        have = self.entries.get(key)
        if cas is not None and cas != (have[-1][0] if have else 0):
            raise InvalidCAS(f"key {key!r} isn't at {cas}")
        old = have[-1] if have else None
        if op == "remove" and not have:
            return None  # no seqno is used
        at = self.seqno + 1 if seqno is None else seqno
        self.seqno = max(self.seqno, at)
        if op == "remove":
            del self.entries[key]
        elif op == "set":
            self.entries[key] = [(at, value, False)]
        elif op == "insert":
            self.entries.setdefault(key, []).append((at, value, False))
        elif op == "delete":
            self.entries.setdefault(key, []).append((at, None, True))
        else:
            raise InvalidInput(f"no operation {op}")
        return old

    def rows(self) -> list[tuple]:
        return [(k, *v) for k, versions in self.entries.items() for v in versions]


def _schema(mutations: DataFrame) -> T.StructType:
    return T.StructType([mutations.schema["key"], T.StructField("seqno", T.LongType()), T.StructField("value", mutations.schema["value"].dataType), T.StructField("deleted", T.BooleanType())])


def _folded(rows: DataFrame, schema: T.StructType, by_key: bool, own_seqno: bool, seqno: int = 0) -> DataFrame:
    """The model run over sorted rows (key, seqno, op, value, cas), whose values stay what they are: no number passes through another type.

    By key, one key's entry is held at a time, however many versions others have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        model, last, out = Model(seqno), None, []

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.field(k).type) for k, c in enumerate(zip(*found))], names=VERSION)

        for b in batches:
            for key, at, op, value, cas in zip(*(b.column(c).to_pylist() for c in ("key", "seqno", "op", "value", "cas"))):
                if by_key and key != last and not (key != key and last != last):
                    out += model.rows()
                    model, last = Model(seqno), key
                    if len(out) >= 1 << 14:
                        yield batch(out)
                        out = []
                try:
                    model.apply(op, "nan" if key != key else key, value, cas, at if own_seqno else None)
                except InvalidCAS:
                    pass
        out += model.rows()
        if out:
            yield batch([(float("nan") if k == "nan" and not isinstance(schema["key"].dataType, T.StringType) else k, *v) for k, *v in out])

    return rows.mapInArrow(run, schema)


def cas_fold(mutations: DataFrame) -> DataFrame:
    """Versions that a log with compare-and-set leaves, each mutation having its own seqno: keys in parallel, those that fail skipped."""
    spark = ready(mutations.sparkSession)
    rows = mutations.select("key", "seqno", "op", "value", "cas").repartition(partitions(spark), "key").sortWithinPartitions("key", "seqno")
    return _folded(rows, _schema(mutations), True, True)


def sequential_fold(mutations: DataFrame, order: str, seqno: int = 0) -> DataFrame:
    """Versions where seqnos are given out in turn, a write that does nothing using none.

    Without compare-and-set, only removes of keys that have no version do nothing.
    That is known by key, so numbers are given by counts of ranges and the log is
    folded by key.  With it, whether a write fails depends on the numbers of all
    before it: such a log is folded in one task, as its meaning is sequential.
    """
    ready(mutations.sparkSession)
    if mutations.where("cas IS NOT NULL").isEmpty():
        before = F.lag("op").over(Window.partitionBy("key").orderBy(order))
        idle = (F.col("op") == "remove") & (F.coalesce(before, F.lit("remove")) == "remove")
        rows = mutations.select("key", "op", "value", "cas", F.col(order).alias("_order"), idle.alias("_idle")).where("NOT _idle").drop("_idle")
        numbered = running(rows, ["_order"], _at=F.lit(1).cast("long"))
        return fold(numbered.select("key", (F.col("_at") + seqno).alias("seqno"), "op", "value", "cas"))
    rows = mutations.select("key", F.lit(None).cast("long").alias("seqno"), "op", "value", "cas", F.col(order).alias("_order")).repartition(1).sortWithinPartitions("_order")
    return _folded(rows.drop("_order"), _schema(mutations), False, False, seqno)


def check_commit(table: DataFrame, batch: DataFrame) -> None:
    """Raises InvalidInput if the batch has a version that isn't newer than all of the table."""
    high = table.agg(F.max("seqno")).first()[0]
    low = batch.agg(F.min("seqno")).first()[0]
    if high is not None and low is not None and low <= high:
        raise InvalidInput(f"the batch begins at {low}, the table ends at {high}")


def commit(table: DataFrame, batch: DataFrame, versions: bool = True) -> DataFrame:
    """The table with a newer batch of versions.

    With versions, histories are joined.  Without, a key that the table has gets
    the batch's latest version: a value replaces its history, a tombstone is
    added to it.  A key that is new keeps all its versions of the batch.
    """
    if versions:
        return table.select(VERSION).unionByName(batch.select(VERSION))
    both = table.select(*VERSION, F.lit(False).alias("new")).unionByName(batch.select(*VERSION, F.lit(True).alias("new")))
    flag = lambda c: F.max(F.when(c, True)).over(Window.partitionBy("key")).isNotNull()
    tip = F.max_by(F.struct("seqno", "deleted"), "seqno").over(Window.partitionBy("key"))
    both = both.withColumns({"had": flag(~F.col("new")), "gets": flag(F.col("new")), "tip": tip})
    latest = F.col("new") & (F.col("seqno") == F.col("tip.seqno"))
    keep = ~F.col("had") | ~F.col("gets") | latest | (~F.col("new") & F.col("tip.deleted"))
    return both.where(keep).select(VERSION)


def sticky(table: DataFrame) -> DataFrame:
    """Deletes that keep no history: a key whose latest version is a tombstone has that version only."""
    tip = F.max_by(F.struct("seqno", "deleted"), "seqno").over(Window.partitionBy("key"))
    return table.withColumn("tip", tip).where(~F.col("tip.deleted") | (F.col("seqno") == F.col("tip.seqno"))).select(VERSION)


def random_log(spark: SparkSession, seed: int, sets: int, inserts: int, deletes: int, removes: int, keys: int = 1000, seqno: int = 0) -> DataFrame:
    """A deterministic mix of mutations: all sets first, then the others in a hashed order."""
    n = inserts + deletes + removes
    pick = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n)))
    op = F.when(F.col("id") < sets, "set").when(pick < inserts, "insert").when(pick < inserts + deletes, "delete").otherwise("remove")
    key = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(keys))
    return spark.range(sets + n).select((F.col("id") + 1 + seqno).alias("seqno"), op.alias("op"), key.alias("key"), F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(1 << 20)).cast("double").alias("value"), F.lit(None).cast("long").alias("cas"))
