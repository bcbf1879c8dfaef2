"""The data model: schemas, bounds, compaction cutoffs and errors.

A versioned table is long: one row (key, seqno, value, deleted) for each version
of a key.  A tombstone is a row with deleted true and no value.  A table's
seqno, counts and so on are computed from its rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, SEQNO, VALUE, DELETED = "key", "seqno", "value", "deleted"
VERSION = [KEY, SEQNO, VALUE, DELETED]
OPS = ("set", "insert", "delete", "remove")


def version_schema(key: T.DataType | None = None, value: T.DataType | None = None) -> T.StructType:
    return T.StructType([T.StructField(KEY, key or T.LongType()), T.StructField(SEQNO, T.LongType()), T.StructField(VALUE, value or T.DoubleType()), T.StructField(DELETED, T.BooleanType())])


def mutation_schema(key: T.DataType | None = None, value: T.DataType | None = None) -> T.StructType:
    return T.StructType([T.StructField(SEQNO, T.LongType()), T.StructField("op", T.StringType()), T.StructField(KEY, key or T.LongType()), T.StructField(VALUE, value or T.DoubleType()), T.StructField("cas", T.LongType())])


class TableError(Exception):
    """Base of all errors here."""


class InvalidCAS(TableError):
    """The key's version isn't the one that the writer expected."""


class KeyNotFound(TableError):
    """The key has no version."""


class InvalidInput(TableError):
    """Arguments that contradict each other or the table."""


class InvalidFile(TableError):
    """A file that isn't what it should be."""


class NotSupported(TableError):
    """An operation that this kind of table doesn't have, such as writing to a snapshot."""


@dataclass(frozen=True)
class Bound:
    """One end of a range: of kind unbounded, included or excluded."""

    kind: str = "unbounded"
    at: Any = None

    def __post_init__(self):
        if self.kind not in ("unbounded", "included", "excluded"):
            raise InvalidInput(f"no bound is {self.kind}")

    def above(self, column: Column) -> Column:
        """As the low end."""
        if self.kind == "unbounded":
            return F.lit(True)
        return column >= self.at if self.kind == "included" else column > self.at

    def below(self, column: Column) -> Column:
        """As the high end."""
        if self.kind == "unbounded":
            return F.lit(True)
        return column <= self.at if self.kind == "included" else column < self.at


UNBOUNDED = Bound()


def included(at: Any) -> Bound:
    return Bound("included", at)


def excluded(at: Any) -> Bound:
    return Bound("excluded", at)


def within(column: Column, low: Bound = UNBOUNDED, high: Bound = UNBOUNDED) -> Column:
    """A plain comparison, which reaches the Parquet scan."""
    return low.above(column) & high.below(column)


def whole_range(low: Bound, high: Bound, most: int = 2**63 - 1) -> tuple[int, int] | None:
    """Closed integer range of two bounds, or None where nothing can be in it."""
    lo = 0 if low.kind == "unbounded" else low.at + (low.kind == "excluded")
    hi = most if high.kind == "unbounded" else high.at - (high.kind == "excluded")
    return (lo, hi) if 0 <= lo <= hi and lo <= most else None


@dataclass(frozen=True)
class Cutoff:
    """What compaction drops: mono keeps the latest live version only, tombstone drops tombstoned keys up to a bound, lsm all versions up to it."""

    kind: str
    bound: Bound = UNBOUNDED

    def __post_init__(self):
        if self.kind not in ("mono", "tombstone", "lsm"):
            raise InvalidInput(f"no cutoff is {self.kind}")

    @property
    def noop(self) -> bool:
        return self.kind != "mono" and self.bound == excluded(0)

    def to_bound(self) -> Bound:
        return excluded(0) if self.kind == "mono" else self.bound


MONO = Cutoff("mono")
