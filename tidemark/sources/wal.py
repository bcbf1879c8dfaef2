"""A write-ahead log as Parquet journals: append, rotate, range, replay, purge, group commits of a stream."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.index import Index
from tidemark.operators.shards import running
from tidemark.plans.model import UNBOUNDED, Bound, InvalidInput, whole_range

SCHEMA = "seqno long, op binary"


def journal_name(name: str, number: int, mark: str = "") -> str:
    return f"{name}-journal-{number:03d}{'.' + mark if mark else ''}.parquet"


def parse_journal(file: str) -> tuple[str, int] | None:
    found = re.fullmatch(r"(.+)-journal-(\d{3,})(?:\.[\w-]+)*", file)
    return (found[1], int(found[2])) if found else None


def in_range(log: DataFrame, low: Bound = UNBOUNDED, high: Bound = UNBOUNDED) -> DataFrame:
    """Records within bounds, as a closed range of whole numbers that row groups are skipped by."""
    ends = whole_range(low, high)
    if ends is None:
        return log.limit(0)
    return log.where(F.col("seqno").between(*ends))


def batches(log: DataFrame, size: int) -> DataFrame:
    """(first_seqno, last_seqno, n) of batches of so many seqnos."""
    return log.groupBy(F.floor((F.col("seqno") - 1) / size).alias("batch")).agg(F.min("seqno").alias("first_seqno"), F.max("seqno").alias("last_seqno"), F.count("*").alias("n"))


@dataclass
class Config:
    """journal_limit: bytes from which a journal is archived and the next one begun; seconds: how long a stream's commits are gathered."""

    folder: str
    name: str = "log"
    journal_limit: int = 1 << 30
    seconds: int = 2


@dataclass
class Journal:
    """A journal as it lies there: working (the one that is appended to) or archived, with its seqnos where it has any."""

    number: int
    path: str
    size: int
    state: str
    first: int | None = None
    last: int | None = None


@dataclass
class Wal:
    """A log in a folder. Each journal is a Parquet table of records in order of seqno; one writer appends.

    What is appended goes to the working journal, which is archived when it has
    grown beyond the limit.
    """

    config: Config
    last: int = 0
    number: int = 0
    state: Any = field(default=None, repr=False)

    @property
    def folder(self) -> str:
        return self.config.folder

    @property
    def name(self) -> str:
        return self.config.name

    @classmethod
    def create(cls, spark: SparkSession, config: Config | str, name: str = "log") -> Wal:
        """An empty log; journals of that name that are there are deleted."""
        out = cls(config if isinstance(config, Config) else Config(config, name))
        out.purge(spark)
        return out

    @classmethod
    def load(cls, spark: SparkSession, config: Config | str, name: str = "log", state: Any = None, add: Callable[[Any, int, bytes], Any] | None = None) -> Wal:
        """The log that is there. add(state, seqno, op) is called for its records in order, and gives the next state."""
        out = cls(config if isinstance(config, Config) else Config(config, name), state=state)
        found = out.journals(spark)
        if found:
            out.number = max(found)
            out.last = out.read(spark).agg(F.coalesce(F.max("seqno"), F.lit(0))).first()[0]
        if add is not None:
            out.state = out.fold(spark, state, add)
        return out

    def _fs(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _listed(self, spark: SparkSession) -> dict[str, int]:
        """Journals' files and numbers, whole ones or not."""
        fs, path = self._fs(spark)
        if not fs.exists(path):
            return {}
        parsed = {s.getPath().getName(): parse_journal(s.getPath().getName()) for s in fs.listStatus(path)}
        return {file: p[1] for file, p in parsed.items() if p and p[0] == self.name}

    def journals(self, spark: SparkSession) -> dict[int, str]:
        """Numbers and places of the journals that were written whole; other files are left alone."""
        fs, _ = self._fs(spark)
        whole = lambda file: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{file}/_SUCCESS"))
        return {number: f"{self.folder}/{file}" for file, number in self._listed(spark).items() if whole(file)}

    def describe(self, spark: SparkSession) -> list[Journal]:
        """The journals by number, with sizes, states and seqnos."""
        fs, _ = self._fs(spark)
        found = self.journals(spark)
        out = []
        for k in sorted(found):
            ends = spark.read.schema(SCHEMA).parquet(found[k]).agg(F.min("seqno"), F.max("seqno")).first()
            size = fs.getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(found[k])).getLength()
            out.append(Journal(k, found[k], size, "working" if k == max(found) and size < self.config.journal_limit else "archive", *ends))
        return out

    def _working(self, spark: SparkSession) -> str:
        """Where the next records go: the last journal, or a new one if that is archived or a stream's."""
        fs, _ = self._fs(spark)
        plain = f"{self.folder}/{journal_name(self.name, self.number)}"
        path = spark._jvm.org.apache.hadoop.fs.Path(plain)
        if not self.number or not fs.exists(path) or fs.getContentSummary(path).getLength() >= self.config.journal_limit:
            self.number = max([self.number, *self._listed(spark).values()]) + 1
        return f"{self.folder}/{journal_name(self.name, self.number)}"

    def append(self, spark: SparkSession, ops: DataFrame, order: str, op: str = "op") -> int:
        """Records for the rows of a batch, in its order, at the end of the log; the last seqno.

        Numbers are given by range partition and count, so that no task has to
        see all rows.
        """
        rows = running(ops.select(F.col(op).cast("binary").alias("op"), F.col(order).alias("_order")), ["_order"], _at=F.lit(1).cast("long"))
        n = rows.count()
        if n:
            self.write(spark, rows.select((F.col("_at") + self.last).alias("seqno"), "op"))
            self.last += n
        return self.last

    def write(self, spark: SparkSession, records: DataFrame) -> None:
        """Records that have their seqnos, into the working journal."""
        records.select("seqno", "op").sortWithinPartitions("seqno").write.mode("append").parquet(self._working(spark))

    def read(self, spark: SparkSession, low: Bound = UNBOUNDED, high: Bound = UNBOUNDED) -> DataFrame:
        found = self.journals(spark)
        log = spark.read.schema(SCHEMA).parquet(*[found[k] for k in sorted(found)]) if found else spark.createDataFrame([], SCHEMA)
        return in_range(log, low, high)

    def iter(self, spark: SparkSession) -> DataFrame:
        return self.read(spark).orderBy("seqno")

    def fold(self, spark: SparkSession, state: Any, add: Callable[[Any, int, bytes], Any], after: int = 0) -> Any:
        """The state that add(state, seqno, op) gives over the records in order, partition by partition on the driver."""
        for r in self.replay_from(spark, after).toLocalIterator():
            state = add(state, r["seqno"], bytes(r["op"]))
        return state

    def replay_from(self, spark: SparkSession, seqno: int) -> DataFrame:
        """Records newer than a seqno."""
        return self.read(spark, Bound("excluded", seqno)).orderBy("seqno")

    def replay(self, spark: SparkSession, index: Index, mutations: Callable[[DataFrame], DataFrame]) -> Index:
        """The index with what the log has beyond its seqno; mutations(records) reads (op, key, value, cas) out of records."""
        newer = self.read(spark, Bound("excluded", index.to_seqno()))
        return index.write(mutations(newer))

    def purge_till(self, spark: SparkSession, seqno: int) -> int:
        """Deletes journals all of whose records are at most the seqno; how many."""
        fs, _ = self._fs(spark)
        gone = [j for j in self.describe(spark) if (j.last or 0) <= seqno]
        return sum(bool(fs.delete(spark._jvm.org.apache.hadoop.fs.Path(j.path), True)) for j in gone)

    def purge(self, spark: SparkSession) -> None:
        fs, _ = self._fs(spark)
        for file in self._listed(spark):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{file}"), True)
        self.number = self.last = 0

    def stream(self, spark: SparkSession, source: DataFrame, checkpoint: str, once: bool = False):
        """Appends a stream of (seqno, op): a micro-batch is a group commit and becomes a journal, after those that are there.

        The journal is marked with the stream's checkpoint and the batch, so that a
        batch that is run again after a failure overwrites its own journal and no other.
        """
        if not source.isStreaming:
            raise InvalidInput("a stream is needed")
        own = f"{zlib.crc32(checkpoint.encode()):08x}"

        def write(rows: DataFrame, batch: int) -> None:
            mark = f"{own}-{batch}"
            listed = self._listed(spark)
            again = [f for f in listed if f.endswith(f".{mark}.parquet")]
            file = again[0] if again else journal_name(self.name, max([self.number, *listed.values()]) + 1, mark)
            rows.select("seqno", "op").sortWithinPartitions("seqno").write.mode("overwrite").parquet(f"{self.folder}/{file}")
            self.number = max(self.number, parse_journal(file)[1])
            self.last = max(self.last, spark.read.schema(SCHEMA).parquet(f"{self.folder}/{file}").agg(F.coalesce(F.max("seqno"), F.lit(0))).first()[0])

        trigger = {"availableNow": True} if once else {"processingTime": f"{self.config.seconds} seconds"}
        return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
