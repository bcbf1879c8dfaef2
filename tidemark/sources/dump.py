"""A package registry's CSV dump, as tables and as JSON documents at key paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "crates": "created_at string, description string, documentation string, downloads long, homepage string, id long, max_upload_size long, name string, readme string, repository string, updated_at string",
    "categories": "category string, crates_cnt long, created_at string, description string, id long, path string, slug string",
    "keywords": "crates_cnt long, created_at string, id long, keyword string",
    "users": "gh_avatar string, gh_id long, gh_login string, id long, name string",
    "versions": "crate_id long, crate_size long, created_at string, downloads long, features string, id long, license string, num string, published_by long, updated_at string, yanked string",
    "badges": "attributes string, badge_type string, crate_id long",
    "metadata": "total_downloads long",
    "reserved_crate_names": "name string",
    "version_downloads": "version_id long, date string, downloads long",
    "crate_owners": "crate_id long, created_at string, created_by long, owner_id long, owner_kind long",
    "crates_categories": "crate_id long, category_id long",
    "crates_keywords": "crate_id long, keyword_id long",
}
PRIMARY = ("crates", "categories", "keywords", "users")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.csv(f"{folder}/{name}.csv", schema=SCHEMAS[name], header=True, multiLine=True, quote='"', escape='"')


def document_key(name: str) -> Column:
    """Where a row's document lies."""
    login = F.coalesce(F.nullif(F.col("gh_login"), F.lit("")), F.col("id").cast("string")) if name == "users" else None
    last = {"crates": F.col("name"), "categories": F.col("slug"), "keywords": F.col("keyword"), "users": login}[name]
    return F.concat_ws("/", F.lit(name), last)


def documents(rows: DataFrame, name: str) -> DataFrame:
    """(key, json): a document for each row of a primary table."""
    return rows.select(document_key(name).alias("key"), F.to_json(F.struct(*rows.columns)).alias("json"))


def document(rows: DataFrame, name: str) -> DataFrame:
    """(key, json): a secondary table as one array."""
    return rows.agg(F.lit(name).alias("key"), F.to_json(F.collect_list(F.struct(*rows.columns))).alias("json"))


def features(versions: DataFrame) -> DataFrame:
    return versions.withColumn("features", F.from_json("features", "map<string,array<string>>"))


def attributes(badges: DataFrame) -> DataFrame:
    return badges.withColumn("attributes", F.from_json("attributes", "map<string,string>"))
