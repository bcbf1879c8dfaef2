"""Membership filters over key digests: exact bitmaps as columns, and filters that are built per task and merged."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import partitions, ready


def digest(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def folded(d: Column) -> Column:
    """A 64-bit digest folded to 32 bits, as a number of at least 0."""
    return F.shiftrightunsigned(d, 32).bitwiseXOR(d.bitwiseAND(F.lit(0xFFFFFFFF)))


def bitmaps(digests: DataFrame, column: str = "digest") -> DataFrame:
    """(bucket, bitmap) of numbers of at least 0: an exact set, one bitmap for each bucket of them."""
    return digests.groupBy(F.bitmap_bucket_number(column).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bitmap"))


def union(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def cardinality(sets: DataFrame) -> DataFrame:
    return sets.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


def contains(rows: DataFrame, sets: DataFrame, column: str = "digest") -> DataFrame:
    """rows with found: the number is in the set. One join by bucket, then a bit of the bitmap."""
    place = F.bitmap_bit_position(F.col(column))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("bucket", F.bitmap_bucket_number(column)).join(sets, "bucket", "left")
    bit = F.shiftright(byte, 0).bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position({column}) % 8 as int))"))
    return marked.withColumn("found", F.coalesce(bit != 0, F.lit(False))).drop("bucket", "bitmap")


def accept_all(rows: DataFrame) -> DataFrame:
    """The filter that is switched off: every key may be there."""
    return rows.withColumn("found", F.lit(True))


class Filter:
    """What all filters over 64-bit digests have: build, contains, bytes and back; none has false negatives."""

    @classmethod
    def build(cls, keys: np.ndarray) -> Filter:
        raise TypeError(f"{cls.__name__} isn't a kind of filter")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Of each digest, whether it may be among those built in."""
        return np.ones(len(keys), bool)

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key & (2**64 - 1)], np.uint64))[0])

    def to_bytes(self) -> bytes:
        return b""

    @classmethod
    def from_bytes(cls, data: bytes) -> Filter:
        return cls()


class NoFilter(Filter):
    """The filter that is switched off: every key may be there."""

    @classmethod
    def build(cls, keys: np.ndarray) -> NoFilter:
        return cls()


class Bloom(Filter):
    """A Bloom filter over 64-bit digests, as bytes that merge by or."""

    def __init__(self, bits: int = 1 << 16, hashes: int = 5, data: bytes | None = None):
        self.bits, self.hashes = bits, hashes
        self.words = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8).copy()

    @classmethod
    def sized(cls, keys: int, rate: float = 0.01) -> Bloom:
        bits = max(64, int(-keys * np.log(rate) / np.log(2) ** 2))
        return cls(1 << int(np.ceil(np.log2(bits))), max(1, round(-np.log2(rate))))

    @classmethod
    def build(cls, keys: np.ndarray) -> Bloom:
        return cls.sized(max(1, len(keys))).add(keys)

    def _places(self, digests) -> np.ndarray:
        d = np.asarray(digests)
        d = d.view(np.uint64) if d.dtype == np.int64 else d.astype(np.int64).view(np.uint64) if d.dtype != np.uint64 else d
        a, b = d & np.uint64(0xFFFFFFFF), (d >> np.uint64(32)) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(self.hashes, dtype=np.uint64)) & np.uint64(self.bits - 1)

    def add(self, digests) -> Bloom:
        p = self._places(digests).ravel()
        np.bitwise_or.at(self.words, (p >> np.uint64(3)).astype(np.int64), (1 << (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        return self

    def contains(self, digests) -> np.ndarray:
        p = self._places(digests)
        return ((self.words[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(1)

    def union(self, other: Bloom) -> Bloom:
        return Bloom(self.bits, self.hashes, (self.words | other.words).tobytes())

    def to_bytes(self) -> bytes:
        return struct.pack("<B", self.hashes) + self.words.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Bloom:
        return cls(8 * (len(data) - 1), data[0], data[1:])


def bloom(digests: DataFrame, column: str, shape: Bloom) -> Bloom:
    """A filter of fixed size over a whole column: one for each task, by or in groups of tasks, and at last on the driver."""
    ready(digests.sparkSession)
    bits, hashes = shape.bits, shape.hashes

    def partial(batches):
        own = Bloom(bits, hashes)
        for b in batches:
            own.add(b.column(0).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([own.words.tobytes()], pa.binary())], ["data"])

    def merged(batches):
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for data in b.column(0).to_pylist():
                own |= np.frombuffer(data, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["data"])

    rows = digests.select(F.col(column).alias("d")).mapInArrow(partial, "data binary")
    # About the square root of the tasks come to the driver.
    groups = max(1, round(partitions(digests.sparkSession) ** 0.5))
    out = Bloom(bits, hashes)
    for row in rows.repartition(groups).mapInArrow(merged, "data binary").toLocalIterator():
        out = out.union(Bloom(bits, hashes, bytes(row["data"])))
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over the others."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class BinaryFuse(Filter):
    """A binary-fuse filter with three cells a key: no false negatives, about 2**-bits false positives, 1.13 cells a key.

    It is built once for a set of keys that doesn't change; filters don't merge.
    """

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys ^ np.uint64(seed))
        start = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        g = _mix(h + np.uint64(0x9E3779B97F4A7C15))
        at = np.empty((3, len(keys)), np.int64)
        for k in range(3):
            inner = (g >> np.uint64(20 * k)) & np.uint64(segment - 1)
            at[k] = ((start + np.uint64(k)) * np.uint64(segment) + inner).astype(np.int64)
        return at, (h & np.uint64(0xFFFF)).astype(np.uint16)

    @staticmethod
    def _shape(n: int, attempt: int) -> tuple[int, int, int]:
        """Segment length, number of segments that a key may begin in, and cells."""
        # Segments grow with the keys as in the published construction; a few spare cells help small sets.
        segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3))) * (1 + 0.05 * (attempt // 5))
        segments = max(1, int(np.ceil(n * factor / segment)) - 2)
        return segment, segments, (segments + 2) * segment

    @classmethod
    def build(cls, keys: np.ndarray, bits: int = 16) -> BinaryFuse:
        """Peel all keys that stand alone in a cell, round by round, then assign cells in the reverse order."""
        keys = np.unique(keys.astype(np.uint64))
        n, kind = len(keys), np.uint8 if bits == 8 else np.uint16
        for attempt in range(100):
            segment, segments, size = cls._shape(n, attempt)
            seed = int(_mix(np.array([attempt + 1], np.uint64))[0])
            at, prints = cls._places(keys, seed, segment, segments)
            prints = prints.astype(kind)
            degree = np.bincount(at.ravel(), minlength=size)
            total = np.zeros(size, np.int64)
            for k in range(3):
                np.add.at(total, at[k], np.arange(n))
            rounds: list[tuple[np.ndarray, np.ndarray]] = []
            left = n
            single = np.flatnonzero(degree == 1)
            while left and len(single):
                key, where = np.unique(total[single], return_index=True)
                cell = single[where]
                rounds.append((key, cell))
                left -= len(key)
                touched = at[:, key].ravel()
                np.subtract.at(degree, touched, 1)
                np.subtract.at(total, touched, np.tile(key, 3))
                touched = np.unique(touched)
                single = touched[degree[touched] == 1]
            if left:
                continue
            cells = np.zeros(size, kind)
            for key, cell in reversed(rounds):
                # A cell of this round isn't a cell of another key of the same or an earlier round's remainder.
                value = prints[key].copy()
                for k in range(3):
                    value ^= np.where(at[k, key] == cell, kind(0), cells[at[k, key]])
                cells[cell] = value
            return cls(seed, segment, segments, cells)
        raise RuntimeError("no seed lets these keys be peeled")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self._places(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        return (self.cells[at[0]] ^ self.cells[at[1]] ^ self.cells[at[2]]) == prints.astype(self.cells.dtype)

    def __len__(self) -> int:
        return len(self.cells)

    def to_bytes(self) -> bytes:
        return struct.pack("<QIIB", self.seed, self.segment, self.segments, 8 * self.cells.itemsize) + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse:
        seed, segment, segments, bits = struct.unpack_from("<QIIB", data)
        return cls(seed, segment, segments, np.frombuffer(data, np.uint8 if bits == 8 else np.uint16, offset=17))


class Xor8(BinaryFuse):
    """A xor filter: three blocks with a cell of eight bits in each for a key, 1.23 cells a key and about 0.4 % false positives."""

    @staticmethod
    def _shape(n: int, attempt: int) -> tuple[int, int, int]:
        block = (int(n * 1.23 * (1 + 0.02 * attempt)) + 32) // 3
        return block, 1, 3 * block

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys ^ np.uint64(seed))
        at = np.empty((3, len(keys)), np.int64)
        for k in range(3):
            turned = (h << np.uint64(21 * k) | h >> np.uint64(64 - 21 * k)) if k else h
            at[k] = ((turned & np.uint64(0xFFFFFFFF)) * np.uint64(segment) >> np.uint64(32)).astype(np.int64) + k * segment
        return at, (h ^ h >> np.uint64(32)).astype(np.uint16) & np.uint16(0xFF)

    @classmethod
    def build(cls, keys: np.ndarray, bits: int = 8) -> Xor8:
        return super().build(keys, 8)


KINDS: dict[str, type[Filter]] = {"none": NoFilter, "bloom": Bloom, "xor8": Xor8, "fuse": BinaryFuse}
_BUILT = "bucket int, buckets int, kind string, data binary"


def filters(digests: DataFrame, kind: str, buckets: int) -> DataFrame:
    """(bucket, buckets, kind, data): filters over the column digest, one for each bucket, built where the bucket is."""
    ready(digests.sparkSession)
    cls = KINDS[kind]

    def build(t: pa.Table) -> pa.Table:
        data = cls.build(np.unique(t["digest"].to_numpy().view(np.uint64))).to_bytes()
        return pa.table({"bucket": t["bucket"].slice(0, 1), "buckets": pa.array([buckets], pa.int32()), "kind": pa.array([kind]), "data": pa.array([data], pa.binary())})

    keyed = digests.where("digest IS NOT NULL").select(F.pmod("digest", F.lit(buckets)).cast("int").alias("bucket"), "digest").distinct()
    return keyed.groupBy("bucket").applyInArrow(build, _BUILT)


def maybe(digests: DataFrame, built: DataFrame) -> DataFrame:
    """Of the distinct digests, those that the filter of their bucket may have."""
    ready(digests.sparkSession)
    some = built.select("buckets").first()
    if some is None:
        return digests.select("digest").limit(0)

    def screen(batch: pa.Table, own: pa.Table) -> pa.Table:
        if not len(own) or not len(batch):
            return batch.select(["digest"]).slice(0, 0)
        f = KINDS[own["kind"][0].as_py()].from_bytes(own["data"][0].as_py())
        return batch.select(["digest"]).filter(pa.array(f.contains(batch["digest"].to_numpy().view(np.uint64))))

    keyed = digests.select(F.pmod("digest", F.lit(some["buckets"])).cast("int").alias("bucket"), "digest").distinct()
    return keyed.groupBy("bucket").cogroup(built.groupBy("bucket")).applyInArrow(screen, "digest long")
