"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("b", "kb", "mb", "gb", "tb")


def humanize(n: Column) -> Column:
    """Whole units of 1024 with a suffix, the largest of which there is at least one."""
    n = n.cast("long")
    out = F.concat(n.cast("string"), F.lit(UNITS[0]))
    for k, unit in enumerate(UNITS[1:], 1):
        out = F.when(n >= 1 << (10 * k), F.concat(F.floor(n / (1 << (10 * k))).cast("string"), F.lit(unit))).otherwise(out)
    return out


def parse_size(text: Column) -> Column:
    """'10k', '1m', '512' to bytes; null for anything else."""
    number = F.regexp_extract(text, r"^\s*(\d+)\s*([kmgtKMGT]?)[bB]?\s*$", 1)
    power = F.instr(F.lit("kmgt"), F.lower(F.regexp_extract(text, r"^\s*(\d+)\s*([kmgtKMGT]?)[bB]?\s*$", 2)))
    unit = F.regexp_extract(text, r"^\s*(\d+)\s*([kmgtKMGT]?)[bB]?\s*$", 2)
    return F.when(number != "", number.cast("long") * F.when(unit == "", F.lit(1)).otherwise(F.pow(F.lit(1024), power).cast("long")))


def parse_sizes(text: Column) -> Column:
    """A list of sizes with commas, or a range a..b in powers of two."""
    ends = F.split(text, r"\.\.")
    lo, hi = parse_size(F.get(ends, 0)), parse_size(F.get(ends, 1))
    steps = F.sequence(F.lit(0), F.floor(F.log2(hi / lo)).cast("int"))
    return F.when(F.size(ends) == 2, F.transform(steps, lambda k: (lo * F.pow(F.lit(2), k)).cast("long"))).otherwise(F.transform(F.split(text, ","), parse_size))


def age_bucket(then: Column, now: Column, hot_months: int = 3, cold_months: int = 12) -> Column:
    """hot, cold or frozen by months of 30 days."""
    days = F.datediff(now, then)
    return F.when(days < hot_months * 30, "hot").when(days < cold_months * 30, "cold").otherwise("frozen")


def key_path(key: Column, depth: int = 3) -> Column:
    """The first characters of a key, one component each, and the key: a fan-out for directories."""
    n = F.least(F.lit(depth), F.char_length(key))
    heads = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(key, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(heads, F.array(key))


def path(key: Column) -> Column:
    return F.split(key, "/")


def strict_path(key: Column) -> Column:
    """Components of a relative path; '.', '..' and a root are errors."""
    parts = F.split(key, "/")
    bad = F.exists(parts, lambda x: x.isin("", ".", ".."))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a plain path: "), key))).otherwise(parts)


def blob_oid(text: Column) -> Column:
    """The content address of a blob: SHA-1 of its kind, length and bytes."""
    data = text.cast("binary")
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(data).cast("string").cast("binary"), F.unhex(F.lit("00")), data))


def starts_with_path(parts: Column, prefix: Column) -> Column:
    return F.slice(parts, F.lit(1), F.size(prefix)) == prefix
