"""WARC (5): record writing and reading, and a Merkle fixity audit of replicas.

A record's leaf hashes where it lies and its bytes.  Leaves are hashed by
ordered ranges of offsets, RANGE bytes and then FAN times as many at each level,
up to the file; files by the first two hex digits of their name's hash, and
these by the root of the archive.  Each level is written in the order of its
parents.  Two replicas are compared from the root: of a level, only the children
of nodes that differ are read, by row groups, so the leaves that differ are found
in the mismatching branches alone.  As ranges are of offsets, a record that is
missing changes no other record's leaf.

Files are read member by member in one pass.  What can't be read is a row too:
reading goes on at the next place where a record begins, so a damaged replica can
be audited.  Of records, only digests are shuffled, never the bytes.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, partitions, ready, scratch, settle

#: Bytes of the least offset range, how many ranges one of the next level has, and levels of ranges in a file.
RANGE, FAN, LEVELS = 1 << 18, 64, 3
#: Pages of a file.
PAGES = 50
#: Bytes that are unpacked at once, most bytes of a record's fields, and most differing nodes that are written into a filter.
PIECE, HEAD, FEW = 1 << 14, 1 << 20, 1000
#: So many zeros or more are a hole, which ends what can't be read.
HOLE = re.compile(rb"\0{64,}")


def encode(fields: dict[str, str], payload: bytes, compress: bool = False) -> bytes:
    """One record; fields without Content-Length, which is added."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(payload)}\r\n\r\n"
    record = head.encode() + payload + b"\r\n\r\n"
    return gzip.compress(record, mtime=0) if compress else record


class Record(NamedTuple):
    """A stored record: stored has its bytes in the file; payload is None where it can't be read, and problem then says why."""

    offset: int
    stored: bytes
    fields: dict[str, str]
    payload: bytes | None
    problem: str | None = None


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """(unpacked bytes, length) of the gzip member at an offset; it is fed piece by piece, so that the rest of the file isn't copied."""
    z, out, k = zlib.decompressobj(31), [], at
    while not z.eof:
        if k >= len(data):
            raise ValueError("gzip member is cut off")
        try:
            out.append(z.decompress(data[k : k + PIECE]))
        except zlib.error as e:
            raise ValueError(f"no gzip member: {e}") from e
        k = min(len(data), k + PIECE)
    return b"".join(out), k - len(z.unused_data) - at


def _one(data: bytes, view: memoryview, at: int) -> Record:
    packed = data.startswith(b"\x1f\x8b", at)
    record, length, start = (*_member(view, at), 0) if packed else (data, 0, at)
    if not record.startswith(b"WARC/", start):
        raise ValueError("no record")
    end = record.find(b"\r\n\r\n", start, start + HEAD)
    if end < 0:
        raise ValueError("no end of the fields")
    fields = dict(line.split(": ", 1) for line in record[start:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    size = {k.lower(): v for k, v in fields.items()}.get("content-length", "")
    stop = end + 4 + int(size) + 4 if size.isdecimal() and len(size) < 18 else -1
    if stop < 0 or stop > len(record):
        raise ValueError("record is cut off")
    if record[stop - 4 : stop] != b"\r\n\r\n":
        raise ValueError("no end of the record")
    return Record(at, bytes(view[at : at + (length or stop - start)]), fields, record[end + 4 : stop - 4])


def scan(data: bytes) -> Iterator[Record]:
    """All records of a file, plain or with a gzip member each, and between them what can't be read, in pieces from hole to hole; holes of zeros are nothing."""
    view, at, begin, problem = memoryview(data), 0, 0, None

    def lost() -> Iterator[Record]:
        k = begin
        for hole in [*HOLE.finditer(data, begin, at), None]:
            end = hole.start() if hole else at
            if data[k:end].strip(b"\0"):
                yield Record(k, data[k:end], {}, None, problem)
            k = hole.end() if hole else at

    while at < len(data):
        try:
            found = _one(data, view, at)
        except ValueError as e:
            problem = problem or str(e)
            places = [k for k in (data.find(b"WARC/1.", at + 1), data.find(b"\x1f\x8b\x08", at + 1)) if k >= 0]
            at = min(places, default=len(data))
            continue
        yield from lost()
        problem = None
        yield found
        at = begin = at + len(found.stored)
    yield from lost()


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, bytes]]:
    """(offset, length, fields, payload, stored bytes) of the records of a file without damage; damage is a ValueError naming the offset."""
    for r in scan(data):
        if r.payload is None:
            raise ValueError(f"{r.problem} at {r.offset}")
        yield r.offset, len(r.stored), r.fields, r.payload, r.stored


def records(files: DataFrame) -> DataFrame:
    """(file, offset, length, record_id, digest, uri, payload, problem) of the records in files (file, content); one task reads a file.

    digest is that of the stored bytes.  What can't be read is a row with problem and no
    payload, which reaches to the next record or hole of at least 64 zeros; a hole is no row.  Empty
    files, and rows without file or content, have no records.
    """
    ready(files.sparkSession)

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("file").to_pylist(), b.column("content").to_pylist()):
                rows = [(name, r.offset, len(r.stored), r.fields.get("WARC-Record-ID"), hashlib.sha256(r.stored).hexdigest(), r.fields.get("WARC-Target-URI"), r.payload, r.problem) for r in scan(data)]
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "offset", "length", "record_id", "digest", "uri", "payload", "problem"])

    return files.where("file IS NOT NULL AND content IS NOT NULL").select("file", "content").mapInArrow(run, "file string, offset long, length long, record_id string, digest string, uri string, payload binary, problem string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """records() of the WARC files in a folder; a file has at most 2 GB, as Spark reads it as one value."""
    return records(spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file"), "content"))


def pack(pages: Iterable[tuple[int, str, str]], compress: bool = False) -> bytes:
    """A WARC file of (page_id, url, html)."""
    return b"".join(encode({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:page:{page}>", "WARC-Target-URI": url, "Content-Type": "text/html"}, html.encode(), compress) for page, url, html in pages)


def packed(pages: DataFrame, compress: bool = False, ids: int = PAGES) -> DataFrame:
    """(file, content): WARC files of pages, so many ids to a file and at most so many records, in the order of ids.

    A missing url or html is empty; rows without page_id have no record.  Rows
    that repeat are records of their own, in files numbered on.  Other columns
    aren't looked at.
    """
    spark = ready(pages.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    page = F.col("page_id").cast("long")
    rows = pages.where("page_id IS NOT NULL").select(F.floor(page / ids).alias("number"), page.alias("page_id"), text("url"), text("html"))
    rows = rows.repartition(partitions(spark), "number").sortWithinPartitions("number", "page_id", "url", "html")

    def run(batches):
        held: list[tuple] = []
        number = part = -1

        def file():
            content = pack(held, compress)
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{number:08d}-{part:05d}.warc{'.gz' if compress else ''}"]), pa.array([content], pa.binary())], ["file", "content"])

        for b in batches:
            for own, *record in zip(*(c.to_pylist() for c in b.columns)):
                if own != number or len(held) == ids:
                    if held:
                        yield file()
                    number, part, held = own, part + 1 if own == number else 0, []
                held.append(tuple(record))
        if held:
            yield file()

    return rows.mapInArrow(run, "file string, content binary")


#: The record that a damaged replica has more.
MORE = encode({"WARC-Type": "resource", "WARC-Record-ID": "<urn:page:more>"}, b"more")


def damage(file: str, content: bytes) -> bytes | None:
    """A replica of a file with known damage, all of it in place.

    By a file's number, of five: 1 its last record is cut in half, 2 it is missing,
    3 it has one more record.  By the MD5 of a page's id: 00 a bit of its last
    byte but the ends of lines is turned, 01 its first bytes are overwritten,
    02 its bytes are zeros.
    """
    kind = int(file.split("-")[1]) % 5
    if kind == 2:
        return None
    out, last = bytearray(content), 0
    for r in scan(content):
        mark = hashlib.md5(r.fields["WARC-Record-ID"][10:-1].encode()).hexdigest()[:2]
        last, end = r.offset, r.offset + len(r.stored)
        if mark == "00":
            out[end - 5] ^= 1
        elif mark == "01":
            out[last : last + 8] = b"rotten!!"
        elif mark == "02":
            out[last:end] = bytes(end - last)
    if kind == 1:
        out = out[: last + (len(out) - last) // 2]
    return bytes(out) + (MORE if kind == 3 else b"")


def damaged(files: DataFrame) -> DataFrame:
    """Files with the damage of damage()."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("file").to_pylist(), b.column("content").to_pylist()):
                new = damage(name, data)
                if new is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([new], pa.binary())], ["file", "content"])

    return files.mapInArrow(run, "file string, content binary")


def _levels(level: int) -> list[Column]:
    """The columns that name a node: of level 0 a record, 1..LEVELS ranges, LEVELS + 1 a file, then two hex digits and the root."""
    if level == 0:
        return [F.col("file"), F.col("offset")]
    if level <= LEVELS:
        return [F.col("file"), F.floor(F.col("offset") / (RANGE * FAN ** (level - 1)))]
    if level == LEVELS + 1:
        return [F.col("file"), F.lit(0)]
    return [F.substring(F.sha2(F.col("file"), 256), 1, 2) if level < TOP else F.lit(""), F.lit(0)]


TOP = LEVELS + 3


def _write(nodes: DataFrame, level: int, folder: str) -> DataFrame:
    """A level's nodes with their parent, written in the order of parents."""
    up, place = _levels(min(level + 1, TOP))
    nodes = nodes.withColumns({"up": up, "up_place": place.cast("long")})
    # Above the first ranges, a level is a small share of the one below.
    ordered = nodes.repartitionByRange("up", "up_place") if level < 2 else nodes.coalesce(8)
    ordered.sortWithinPartitions("up", "up_place").write.parquet(f"{folder}/{level}")
    return nodes.sparkSession.read.parquet(f"{folder}/{level}")


def tree(records: DataFrame, folder: str) -> list[DataFrame]:
    """Nodes (node, place, side, file, offset, hash, up, up_place) of the trees of all sides by level, leaves first, written to a folder.

    file and offset are those of a node's first record; up and up_place name its parent.
    """
    leaf = F.sha2(F.concat_ws("|", F.col("offset").cast("string"), F.col("length").cast("string"), "digest"), 256)
    # Different records at one place, as only a faulty replica has, are one leaf; equal ones count once.
    nodes = records.withColumn("leaf", leaf).groupBy("side", "file", "offset").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("leaf")), "|"), 256).alias("hash"))
    out = []
    for level in range(TOP + 1):
        node, place = _levels(level)
        nodes = nodes.select(node.alias("node"), place.cast("long").alias("place"), "side", "file", "offset", "hash")
        if level:
            children = F.array_sort(F.collect_list(F.struct("file", "offset", "hash"))).alias("c")
            text = F.transform("c", lambda x: F.concat_ws("|", x["file"], x["offset"].cast("string"), x["hash"]))
            grouped = nodes.groupBy("node", "place", "side").agg(children)
            nodes = grouped.select("node", "place", "side", F.col("c")[0]["file"].alias("file"), F.col("c")[0]["offset"].alias("offset"), F.sha2(F.array_join(text, "|"), 256).alias("hash"))
        nodes = _write(nodes, level, folder)
        out.append(nodes)
    return out


def children(nodes: DataFrame, differing: DataFrame) -> DataFrame:
    """The nodes of a level below the differing ones (d_node, d_place) of the next; few of them are a filter on row groups."""
    some = differing.limit(FEW + 1).collect()
    if len(some) <= FEW:
        nodes = nodes.where(F.col("up").isin([r["d_node"] for r in some]) & F.col("up_place").isin([r["d_place"] for r in some]))
    return nodes.join(few(differing), (F.col("up") == F.col("d_node")) & (F.col("up_place") == F.col("d_place")), "left_semi")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, offset, length, record_id, status) of the records in which two replicas differ.

    status is changed (other bytes, another length or unreadable, also where several
    unreadable records are one piece of the replica), missing (from the
    replica) or extra (in the replica only); length and record_id are the primary's,
    or for extra records the replica's.  Equal or empty replicas give no rows.
    Records are (file, offset, length, record_id, digest) and, where it is known,
    problem, which is not null for what can't be read; other columns aren't looked at; rows without file or offset are left out; records that repeat at one
    place are one.
    """
    spark = ready(primary.sparkSession)
    columns = ["file", "offset", "length", "record_id", "digest"]
    unread = [F.col("problem").isNotNull() if "problem" in x.columns else F.lit(False) for x in (primary, replica)]
    sides = [x.where("file IS NOT NULL AND offset IS NOT NULL").select(*columns, F.lit(k).alias("side"), unread[k].alias("unread")) for k, x in enumerate((primary, replica))]
    records = settle(sides[0].unionByName(sides[1]))
    with scratch(spark, "fixity") as folder:
        levels = tree(records, folder)
        differing = None
        for level in range(TOP, -1, -1):
            nodes = levels[level] if differing is None else children(levels[level], differing)
            hashes = [F.max(F.when(F.col("side") == k, F.col("hash"))).alias(h) for k, h in enumerate(("a", "b"))]
            found = nodes.groupBy("node", "place").agg(*hashes).where("NOT (a <=> b)")
            differing = settle(found.select(F.col("node").alias("d_node"), F.col("place").alias("d_place"), F.col("a").isNull().alias("extra"), F.col("b").isNull().alias("missing")))
    place = (F.col("file") == F.col("d_node")) & (F.col("offset") == F.col("d_place"))
    own = ["file", "offset", "length", "record_id"]
    rows = records.join(few(differing), place).where("side = CAST(extra AS INT)").select(*own, "extra", "missing", F.lit(None).cast("long").alias("until"))
    # Where an unreadable piece of the replica lies over a record's place, its bytes are there, but can't be read.
    pieces = records.where("side = 1 AND unread").select(*own, F.lit(None).cast("boolean").alias("extra"), F.lit(None).cast("boolean").alias("missing"), (F.col("offset") + F.col("length")).alias("until"))
    before = Window.partitionBy("file").orderBy("offset").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.unionByName(pieces).withColumn("reach", F.max("until").over(before)).where("missing IS NOT NULL")
    status = F.when(F.col("extra"), "extra").when(F.col("missing") & ~F.coalesce(F.col("reach") > F.col("offset"), F.lit(False)), "missing").otherwise("changed").alias("status")
    rows = rows.select(*own, status)
    return rows.groupBy("file", "offset", "status").agg(F.min("length").alias("length"), F.min("record_id").alias("record_id")).select("file", "offset", "length", "record_id", "status")


def audit_pages(pages: DataFrame) -> DataFrame:
    """The files that pages make, byte by byte, against a replica of them with known damage."""
    files = settle(packed(pages))
    return audit(records(files), records(damaged(files)))


SQL = f"""
    WITH p AS (
        SELECT page_id, page_id // {PAGES} AS number, coalesce(url, '') AS url, coalesce(html, '') AS html,
               row_number() OVER (PARTITION BY page_id // {PAGES} ORDER BY page_id, coalesce(url, ''), coalesce(html, '')) - 1 AS k
        FROM pages WHERE page_id IS NOT NULL),
    r AS (
        SELECT number, k, md5(CAST(page_id AS VARCHAR))[1:2] AS mark, '<urn:page:' || CAST(page_id AS VARCHAR) || '>' AS record_id,
               format('pages-{{:08d}}-{{:05d}}.warc', CAST(number AS INTEGER), CAST(k // {PAGES} AS INTEGER)) AS file,
               CAST(128 + length(CAST(page_id AS VARCHAR)) + strlen(url) + length(CAST(strlen(html) AS VARCHAR)) + strlen(html) AS BIGINT) AS length
        FROM p),
    o AS (
        SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
               k = max(k) OVER (PARTITION BY file) AS last
        FROM r)
    SELECT file, CAST(before AS BIGINT) AS "offset", length, record_id,
           CASE WHEN number % 5 = 2 OR mark = '02' THEN 'missing' ELSE 'changed' END AS status
    FROM o WHERE number % 5 = 2 OR mark IN ('00', '01', '02') OR (number % 5 = 1 AND last)
    UNION ALL
    SELECT file, CAST(before + length AS BIGINT), CAST({len(MORE)} AS BIGINT), '<urn:page:more>', 'extra' FROM o WHERE number % 5 = 3 AND last"""
