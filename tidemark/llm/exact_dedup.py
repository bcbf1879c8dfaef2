"""Exact dedup (7): static binary-fuse filters over an immutable snapshot screen incoming digests.

The snapshot's 64-bit digests are split into buckets and each bucket gets a
binary-fuse filter of 16-bit fingerprints, which no later batch changes.
Incoming digests meet the filter of their bucket; the few that pass join the
snapshot's exact bucket, where the bytes of the texts are compared.  Copies
within the incoming batch are grouped by themselves.  Nothing is broadcast that
grows with the data unchecked, and only texts whose digest occurs twice are
moved.  A Snapshot's digests and filters are computed once and kept beside it;
a batch that comes later reads them and, of the snapshot's texts, its suspects.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.membership import BinaryFuse

from .common import few, narrow, only, partitions, ready, settle

_FILTER = "bucket int, buckets int, seed long, segment int, segments int, cells binary"
#: Digests of a filter, about: 2.3 bytes each.
KEYS = 1 << 22


def _build(table: pa.Table) -> pa.Table:
    f = BinaryFuse.build(table["digest"].to_numpy().view(np.uint64))
    return pa.table({
        "bucket": table["bucket"].slice(0, 1), "buckets": table["buckets"].slice(0, 1), "seed": pa.array(np.array([f.seed], np.uint64).view(np.int64)),
        "segment": pa.array([f.segment], pa.int32()), "segments": pa.array([f.segments], pa.int32()), "cells": pa.array([f.cells.tobytes()], pa.binary()),
    })


def _keyed(digests: DataFrame, buckets: int) -> DataFrame:
    return digests.select(F.pmod(F.col("digest"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(buckets).alias("buckets"), "digest").distinct()


def snapshot_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One filter for each bucket of a snapshot's digests; to be written beside the snapshot and kept as long as it.

    Each filter says of how many buckets it is one, so that whoever reads it later asks the right one.
    """
    return _keyed(digests, buckets).groupBy("bucket").applyInArrow(_build, _FILTER)


def _screen(batch: pa.Table, filters: pa.Table) -> pa.Table:
    if not len(filters) or not len(batch):
        return batch.select(["digest"]).slice(0, 0)
    f = filters.to_pylist()[0]
    fuse = BinaryFuse(f["seed"] & (2**64 - 1), f["segment"], f["segments"], np.frombuffer(f["cells"], np.uint16))
    return batch.select(["digest"]).filter(pa.array(fuse.contains(batch["digest"].to_numpy().view(np.uint64))))


def screen(digests: DataFrame, filters: DataFrame) -> DataFrame:
    """Digests that their bucket's filter may hold; without filters, none."""
    counts = [r["buckets"] for r in filters.select("buckets").distinct().limit(2).collect()]
    if len(counts) > 1:
        raise ValueError(f"filters of {counts} buckets don't belong to one snapshot")
    if not counts:
        return digests.select("digest").limit(0)
    return _keyed(digests, counts[0]).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_screen, "digest long")


def digests_of(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of the rows that have id and text."""
    return narrow(docs).select("doc_id", F.xxhash64("text").alias("digest"))


@dataclass
class Snapshot:
    """An immutable table of documents with what is kept beside it: its digests, and the filters over them."""

    docs: DataFrame
    digests: DataFrame
    filters: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, buckets: int | None = None) -> Snapshot:
        """Digests and filters computed once."""
        digests = settle(digests_of(docs))
        if buckets is None:
            buckets = max(partitions(docs.sparkSession), -(-digests.count() // KEYS))
        return cls(docs, digests, settle(snapshot_filters(digests, buckets)))

    def write(self, path: str) -> None:
        self.digests.write.parquet(f"{path}/digests")
        self.filters.write.parquet(f"{path}/filters")

    @classmethod
    def read(cls, docs: DataFrame, path: str) -> Snapshot:
        read = docs.sparkSession.read.parquet
        return cls(docs, read(f"{path}/digests"), read(f"{path}/filters"))


def _copies(batch: DataFrame, snapshot: DataFrame | Snapshot | None) -> DataFrame:
    ready(batch.sparkSession)
    if isinstance(snapshot, DataFrame):
        snapshot = Snapshot.of(snapshot)
    rows = narrow(batch).withColumn("old", F.lit(False))
    new = digests = settle(digests_of(batch).withColumn("old", F.lit(False)))
    if snapshot is not None:
        rows = rows.unionByName(narrow(snapshot.docs).withColumn("old", F.lit(True)))
        digests = new.unionByName(snapshot.digests.withColumn("old", F.lit(True)))
    repeated = digests.groupBy("old", "digest").count().where("count > 1").select("digest")
    suspects = repeated if snapshot is None else repeated.union(screen(new.select("digest"), snapshot.filters))
    suspects = settle(suspects.distinct())
    # Only the texts of suspects go on to the byte check: digests name their ids.  Another
    # text under such an id has a digest that no second row has, and makes no class below.
    named = settle(digests.join(few(suspects), "digest", "left_semi"))
    ids = settle(named.select("doc_id").distinct())
    rows = only(rows, ids).withColumn("digest", F.xxhash64("text"))
    # The byte check: texts are grouped by themselves within each suspected digest.
    classes = (
        rows.groupBy("digest", "text")
        .agg(F.min("doc_id").alias("least"), F.min(F.when(F.col("old"), F.col("doc_id"))).alias("oldest"), F.count("*").alias("copies"))
        .select("digest", "text", F.coalesce("oldest", "least").alias("duplicate_of"), "copies")
        .withColumn("texts", F.count("*").over(Window.partitionBy("digest")))
        .where("texts > 1 OR copies > 1")
        .withColumn("text", F.when(F.col("texts") > 1, F.col("text")))
    )
    classes = settle(classes)
    columns = ["doc_id", "digest", "duplicate_of", "copies"]
    every = named.join(classes.where("texts = 1"), "digest").select(columns)
    if not classes.where("texts > 1").isEmpty():
        # Different texts with one digest, about never: the texts themselves are joined.
        clash = rows.join(classes.where("texts > 1 AND copies > 1").drop("texts"), ["digest", "text"])
        every = every.union(clash.select(columns))
    return every.groupBy(columns).agg(F.count("*").alias("_n")).where("doc_id <> duplicate_of OR _n > 1").drop("_n")


def copies(batch: DataFrame, snapshot: DataFrame | Snapshot | None = None) -> DataFrame:
    """Rows of batch and snapshot that repeat another's text: (doc_id, duplicate_of, copies).

    A Snapshot brings its digests and filters, which no batch computes again.

    duplicate_of is the smallest doc_id with the same bytes, of the snapshot if
    it has any, else of the batch.  copies counts the rows with that text.  A row
    that repeats id and text of another is listed once with duplicate_of equal to
    doc_id; a row without doc_id or text is never a copy; empty texts equal each
    other.  Case, white space and Unicode forms count: only equal bytes are equal.
    Whole texts are compared, however long; empty tables have no copies; other
    columns aren't looked at.
    """
    return _copies(batch, snapshot).drop("digest")


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot, batch): the older and the newer half of the range of ids, which grow as documents arrive.

    Rows without an id belong to the batch.
    """
    ids = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    middle = (ids.lo + ids.hi) // 2 if ids.lo is not None else 0
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    return docs.where(old), docs.where(~old)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs without exact copies: of each text the row with the smallest doc_id of the snapshot, else of the batch, stays, once.

    Rows without doc_id or text stay as they are; a doc_id that repeats with
    other texts loses only the rows that are copies; columns stay as they are.
    """
    snapshot, batch = halves(docs)
    found = settle(_copies(batch, snapshot).select("doc_id", "digest", "duplicate_of"))
    gone = few(found.select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_digest")))
    same = (docs["doc_id"].cast("long") == gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_digest"])
    kept = docs.join(gone, same, "left_anti")
    again = settle(found.where("doc_id = duplicate_of").select("doc_id", "digest"))
    if again.isEmpty():
        return kept
    # Whole rows that repeat: of those with one id and text, one stays.
    again = few(again.select(F.col("doc_id").alias("_again"), F.col("digest").alias("_digest")))
    same = (docs["doc_id"].cast("long") == again["_again"]) & (F.xxhash64(docs["text"]) == again["_digest"])
    return kept.unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
