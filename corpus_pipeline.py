"""From documents to a training mix: toxicity, exact dedup, near-dedup, benchmark decontamination, mixing.

Each stage takes all documents that the one before it kept, read again from the
Parquet table that the caller wrote, and all but the last return the columns of
documents.  No stage can be expressed in SQL as a whole (a trained classifier,
sketches, WAND, seeded draws), so ORACLE_SQL is None and the tests compare run()
with brute force.

Rows that a stage can't judge, having no doc_id or no text, stay in the corpus: they
are no copies, hold no test item and aren't toxic, and the mix has them under their
source.  Empty tables give empty results; whole texts are judged, however long;
columns that documents has beside its own are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import remove, shared
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.toxicity import clean

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine fitted on the labels doesn't find toxic; all rows of an id go if one of its texts is."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one with the smallest doc_id of the older half of the ids, else of the newer."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left as shards of mixed sources, with columns shard and position."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("near dedup", near),
    ("benchmark decontamination", benchmark),
    ("source mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written to the shared folder and read again, and what is read to the end is deleted."""
    base = f"{shared(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
