"""ZIM archives: directory entries, blobs, redirects; read by clusters in parallel."""

from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.plans.model import InvalidFile

MAGIC = 0x44D495A
ENTRY = "id int, mime string, namespace string, revision int, url string, title string, cluster int, blob int, redirect int"
BLOB = "cluster int, blob int, content binary"
COMPRESSION = {0: "none", 1: "none", 2: "zlib", 3: "bzip2", 4: "xz", 5: "zstd"}
NAMESPACES = {"I": "image", "A": "article", "C": "content", "M": "metadata", "W": "well-known", "X": "index", "-": "layout"}


def namespace(code: str) -> str:
    if code not in NAMESPACES:
        raise InvalidFile(f"no namespace {code!r}")
    return NAMESPACES[code]


class Archive:
    """An open archive; parts are read when they're asked for."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        head = self.file.read(80)
        if len(head) < 80 or struct.unpack_from("<I", head)[0] != MAGIC:
            raise InvalidFile(f"{path} isn't a ZIM archive")
        names = ("major", "minor", "uuid", "entry_count", "cluster_count", "url_at", "title_at", "cluster_at", "mime_at", "main_page", "layout_page", "checksum_at")
        self.header = dict(zip(names, struct.unpack_from("<HH16sIIQQQQIIQ", head, 4)))
        self.file.seek(0, 2)
        self.size = self.file.tell()

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def _string(self, place: int) -> tuple[str, int]:
        data = b""
        while b"\0" not in data:
            more = self._at(place + len(data), 256)
            if not more:
                raise InvalidFile("a string isn't ended")
            data += more
        raw = data[: data.index(b"\0")]
        return raw.decode("utf-8", "replace"), place + len(raw) + 1

    def mimes(self) -> list[str]:
        out, place = [], self.header["mime_at"]
        while True:
            text, place = self._string(place)
            if not text:
                return out
            out.append(text)

    def entry(self, k: int, mimes: list[str]) -> tuple:
        place = struct.unpack("<Q", self._at(self.header["url_at"] + 8 * k, 8))[0]
        mime, extra, space, revision = struct.unpack("<HBcI", self._at(place, 8))
        redirect = cluster = blob = None
        if mime == 0xFFFF:
            redirect = struct.unpack("<I", self._at(place + 8, 4))[0]
            place += 12
        elif mime in (0xFFFE, 0xFFFD):
            place += 8
        else:
            cluster, blob = struct.unpack("<II", self._at(place + 8, 8))
            place += 16
        url, place = self._string(place)
        title, _ = self._string(place)
        return k, None if mime >= 0xFFFD else mimes[mime], space.decode("latin-1"), revision, url, title or url, cluster, blob, redirect

    def titles(self) -> list[int]:
        return list(struct.unpack(f"<{self.header['entry_count']}I", self._at(self.header["title_at"], 4 * self.header["entry_count"])))

    def cluster(self, k: int) -> list[bytes]:
        n = self.header["cluster_count"]
        places = struct.unpack(f"<{n}Q", self._at(self.header["cluster_at"], 8 * n))
        ends = sorted([*places, self.header["checksum_at"] or self.size])
        data = self._at(places[k], ends[ends.index(places[k]) + 1] - places[k])
        kind, wide = COMPRESSION.get(data[0] & 15), data[0] & 16
        if kind == "xz":
            body = lzma.LZMADecompressor().decompress(data[1:])
        elif kind == "zstd":
            import zstandard

            body = zstandard.ZstdDecompressor().decompressobj().decompress(data[1:])
        elif kind == "none":
            body = data[1:]
        else:
            raise InvalidFile(f"clusters with {kind} aren't read")
        size, code = (8, "Q") if wide else (4, "I")
        count = struct.unpack_from("<" + code, body)[0] // size
        offsets = struct.unpack_from(f"<{count}{code}", body)
        return [body[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


class _Part(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.what, self.parts = options["path"], options.get("table", "entries"), int(options.get("partitions", "32"))

    def partitions(self):
        n = Archive(self.path).header["entry_count" if self.what == "entries" else "cluster_count"]
        k = max(1, min(n, self.parts))
        return [_Part(n * i // k, n * (i + 1) // k) for i in range(k)]

    def read(self, part: _Part) -> Iterator[tuple]:
        a = Archive(self.path)
        if self.what == "entries":
            mimes = a.mimes()
            for k in range(part.lo, part.hi):
                yield a.entry(k, mimes)
        else:
            for k in range(part.lo, part.hi):
                for i, data in enumerate(a.cluster(k)):
                    yield k, i, data


class ZimDataSource(DataSource):
    """format('zim'): option table is entries or blobs."""

    @classmethod
    def name(cls) -> str:
        return "zim"

    def schema(self) -> str:
        return ENTRY if self.options.get("table", "entries") == "entries" else BLOB

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def entries(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ZimDataSource)
    return spark.read.format("zim").option("table", "entries").load(path)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ZimDataSource)
    return spark.read.format("zim").option("table", "blobs").load(path)


def header(spark: SparkSession, path: str) -> DataFrame:
    h = dict(Archive(path).header)
    h["uuid"] = h["uuid"].hex()
    return spark.createDataFrame([h])


def mimes(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(Archive(path).mimes())), "id int, mime string")


def resolved(rows: DataFrame, hops: int = 16) -> DataFrame:
    """(id, target): each entry with the one that its redirects end at; null where they don't end.

    Pointers are doubled, so n hops take log n joins.
    """
    at = rows.select("id", F.coalesce("redirect", "id").alias("target"))
    for _ in range(max(1, hops.bit_length())):
        on = at.select(F.col("id").alias("target"), F.col("target").alias("next"))
        at = at.join(on, "target", "left").select("id", F.col("next").alias("target"))
    ends = rows.where("redirect IS NULL").select(F.col("id").alias("target"), F.lit(True).alias("ends"))
    return at.join(ends, "target", "left").select("id", F.when(F.col("ends"), F.col("target")).alias("target"))


def contents(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Entries with the content that they or their redirects lead to."""
    final = rows.select(F.col("id").alias("target"), "cluster", "blob")
    return rows.drop("cluster", "blob").join(resolved(rows), "id").join(final, "target").join(blobs, ["cluster", "blob"])


def by_mime(rows: DataFrame, mimes: DataFrame) -> DataFrame:
    """(mime, n), also for types that no entry has."""
    counts = rows.where("redirect IS NULL").groupBy("mime").agg(F.count("*").alias("n"))
    return mimes.select("mime").distinct().join(counts, "mime", "left").select("mime", F.coalesce("n", F.lit(0)).alias("n"))


def by_namespace(rows: DataFrame) -> DataFrame:
    return rows.groupBy("namespace").agg(F.count("*").alias("n"))


def info(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("redirect").isNull()).alias("entries"), F.count_if(F.col("redirect").isNotNull()).alias("redirects"))


def by_cluster(rows: DataFrame) -> DataFrame:
    """(cluster, ids) of the entries in each cluster."""
    return rows.where("cluster IS NOT NULL").groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("ids"))
