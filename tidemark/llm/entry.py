"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact_dedup, mixing, near_dedup, pii, secrets, suffix_dedup, toxicity, warc
from .common import documents, ready


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(documents(spark, sf_dir))


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_windows(_table(spark, sf_dir, "conversations"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The WARC files that the pages make against a replica with known damage."""
    return warc.audit_pages(_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, batch = exact_dedup.halves(documents(spark, sf_dir))
    return exact_dedup.copies(batch, snapshot)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(documents(spark, sf_dir))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_chat_windows, op3_source_mixing, op4_secret_scan, op5_warc_fixity, op6_decontamination, op7_exact_dedup, op8_suffix_dedup, op9_pii_pseudonyms, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc_fixity": warc.SQL,
        "op7_exact_dedup": """
            SELECT doc_id, duplicate_of, copies
            FROM (SELECT doc_id, min(doc_id) OVER same AS duplicate_of, count(*) OVER same AS copies
                  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
                  WINDOW same AS (PARTITION BY text))
            WHERE doc_id <> duplicate_of""",
    }
