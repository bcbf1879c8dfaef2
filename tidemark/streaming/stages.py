"""Dataflow stages over a stream: source, map, filter, filter-map, reduce, split, sinks.

A stream of messages is an unbounded table; stages are its transformations and
run together in one query.  There is no event time here: reduce gives one row at
the end of a bounded stream, which an availableNow query reads to its end, so no
message is lost.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Sequence
from itertools import count, islice
from typing import Any

import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import ready


def from_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the rows of Parquet files; files_per_trigger holds back what comes too fast."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def from_rate(spark: SparkSession, per_second: int) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def from_iter(spark: SparkSession, rows: Iterable[tuple], schema, folder: str, chunk: int = 10_000, files_per_trigger: int = 64) -> DataFrame:
    """A stream of what an iterator gives: it is written to a folder in chunks, one file each, and read from there."""
    it = iter(rows)
    for k in count():
        part = list(islice(it, chunk))
        if not part and k:
            break
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return from_files(spark, folder, spark.createDataFrame([], schema).schema, files_per_trigger)


def from_gen(spark: SparkSession, make: Callable[[int], tuple | None], schema, folder: str, **more) -> DataFrame:
    """A stream of make(0), make(1), ... up to the first None."""
    return from_iter(spark, iter(map(make, count()).__next__, None), schema, folder, **more)


def map_(stream: DataFrame, **columns: Column) -> DataFrame:
    return stream.select(*[c.alias(n) for n, c in columns.items()])


def filter_(stream: DataFrame, keep: Column) -> DataFrame:
    return stream.where(keep)


def filter_map(stream: DataFrame, name: str, value: Column) -> DataFrame:
    """One value or none for each message: nulls are dropped."""
    return stream.select(value.alias(name)).where(F.col(name).isNotNull())


def reduce_(stream: DataFrame, **totals: Column) -> DataFrame:
    """One row of associative aggregates, also of no messages."""
    return stream.agg(*[c.alias(n) for n, c in totals.items()])


class _Stopped(Exception):
    """A sink wanted no more."""


class Run:
    """A running query; close_wait() waits for its end, calls finish once and raises what a stage raised."""

    def __init__(self, query: StreamingQuery, state: dict, finish: Callable[[], object] | None):
        self.query, self.state, self.finish = query, state, finish

    def close_wait(self) -> None:
        try:
            self.query.awaitTermination()
        except StreamingQueryException:
            if not self.state.get("stopped"):
                raise
        if self.finish is not None and not self.state.setdefault("finished", False):
            self.state["finished"] = True
            self.finish()


def run(stream: DataFrame, sink: Callable[[DataFrame, int], object], checkpoint: str, complete: bool = False, finish: Callable[[], object] | None = None) -> Run:
    """Runs to the end of what there is. sink gets each micro-batch; if it returns False the query stops after it.

    What follows isn't handed on, and isn't committed either: a later run from the
    same checkpoint goes on with it.  finish is called once, at the end.
    """
    state: dict = {}

    def each(rows: DataFrame, number: int) -> None:
        if state.get("stopped"):
            # Before this batch is committed.
            raise _Stopped
        if sink(rows, number) is False:
            state["stopped"] = True

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("complete" if complete else "append")
    return Run(writer.trigger(availableNow=True).start(), state, finish)


def fold(stream: DataFrame, identity: Any, step: Callable[[Any, dict], Any], combine: Callable[[Any, Any], Any], sink: Callable[[Any], object], checkpoint: str) -> Run:
    """Any reduction: step(state, row) within tasks, combine(state, state) over tasks and micro-batches; sink gets the one result at the end.

    identity must be neutral to combine, and combine associative and commutative,
    as tasks end in any order.  What comes to the driver is one state a task.
    """
    ready(stream.sparkSession)
    total = [identity]

    def partial(batches):
        state = identity
        for b in batches:
            for row in b.to_pylist():
                state = step(state, row)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    def each(rows: DataFrame, _: int) -> None:
        for r in rows.mapInArrow(partial, "state binary").toLocalIterator():
            total[0] = combine(total[0], pickle.loads(bytes(r["state"])))  # noqa: S301

    return run(stream, each, checkpoint, finish=lambda: sink(total[0]))


def split(stream: DataFrame, sinks: Sequence[Callable[[DataFrame, int], object]], checkpoint: str, finish: Callable[[], object] | None = None) -> Run:
    """Every message to every sink: a micro-batch is computed once and handed to all. If all sinks return False the query stops."""

    def all_(rows: DataFrame, number: int) -> bool:
        kept = rows.persist()
        try:
            return any([sink(kept, number) is not False for sink in sinks])
        finally:
            kept.unpersist()

    return run(stream, all_, checkpoint, finish=finish)


def drain(stream: DataFrame, checkpoint: str) -> Run:
    """Reads all messages and keeps none."""
    return Run(stream.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), {}, None)


def close_wait(run: Run | StreamingQuery) -> None:
    """Waits for the end; an error of a stage is raised here."""
    run.close_wait() if isinstance(run, Run) else run.awaitTermination()
