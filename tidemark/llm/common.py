"""What the operators of this subpackage share: removal of rows by id, columns, and the session's helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import partitions, ready, remove, scratch, settle, shared

__all__ = ["documents", "few", "named", "narrow", "only", "partitions", "ready", "remove", "scratch", "settle", "shared", "without"]
#: Most ids that are broadcast (about 40 MB as a hash relation); beyond that they're joined by shuffle.
BROADCAST_IDS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def named(docs: DataFrame) -> Column:
    """Rows that an operator can judge: they have an id and a text."""
    return F.col("doc_id").isNotNull() & F.col("text").isNotNull()


def narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows that have both; other columns, whatever their names, stay out of the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(named(docs))


def few(ids: DataFrame) -> DataFrame:
    """The ids (settled first), marked for broadcast if there are at most BROADCAST_IDS of them."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't among ids.doc_id (distinct and settled); rows without a doc_id stay."""
    gone = few(ids.select(F.col("doc_id").alias("_gone")))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is among ids.doc_id (distinct and settled)."""
    wanted = few(ids.select(F.col("doc_id").alias("_wanted")))
    return docs.join(wanted, docs["doc_id"].cast("long") == wanted["_wanted"], "left_semi")
