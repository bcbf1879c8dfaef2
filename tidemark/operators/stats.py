"""Histograms, nearest-rank percentiles and throughput."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shards import running


def histogram(rows: DataFrame, column: str, width: float, buckets: int) -> DataFrame:
    """(bucket, n): values by buckets of equal width, the last one also having all that lies beyond."""
    bucket = F.least(F.floor(F.col(column) / width), F.lit(buckets - 1)).cast("long")
    return rows.where(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).groupBy("bucket").agg(F.sum("n").alias("n"))


def percentiles(hist: DataFrame, above: int = 90) -> DataFrame:
    """(percentile, bucket): each bucket at which the whole percentage of values so far is greater than before, and than `above`."""
    so_far = F.floor(F.sum("n").over(Window.orderBy("bucket")) * 100 / F.sum("n").over(Window.partitionBy())).cast("long")
    marked = hist.select("bucket", so_far.alias("percentile"))
    before = F.coalesce(F.lag("percentile").over(Window.orderBy("bucket")), F.lit(0))
    return marked.withColumn("before", F.greatest(before, F.lit(above))).where("percentile > before").select("percentile", "bucket")


def summary(rows: DataFrame, column: str) -> DataFrame:
    """n, least, most and whole mean of a column of whole numbers."""
    return rows.agg(F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"), F.floor(F.sum(column) / F.count(column)).cast("long").alias("mean"))


def nearest_rank(rows: DataFrame, column: str, share: float = 0.99) -> DataFrame:
    """The value at place floor(n * share) of the sorted ones.

    Values are counted first; running totals of the counts go by ranges of values.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    until = running(counts, ["value"], until=F.col("n"))
    total = until.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return until.where(F.col("until") > int(Decimal(str(share)) * total)).agg(F.min("value").alias("value"))


def throughput(rows: DataFrame, at: str, amount: str, seconds: int = 1) -> DataFrame:
    """(second, total, n) by tumbling windows; each row is in the window that it falls in."""
    start = F.window(at, f"{seconds} second")["start"]
    return rows.groupBy(start.alias("second")).agg(F.sum(amount).alias("total"), F.count("*").alias("n"))


def join_by_place(one: DataFrame, other: DataFrame) -> DataFrame:
    """Sums by place; a place that one side lacks counts as zero."""
    return one.unionByName(other).groupBy("place").agg(F.sum("total").alias("total"))
