"""Content-addressed objects (blobs, trees, commits), path tables and prefix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import blob_oid, starts_with_path
from tidemark.plans.model import UNBOUNDED, Bound, InvalidInput, KeyNotFound, within


class Store:
    """Blobs by path, with a history of commits.

    files: (path array<string>, content binary, oid); trees: (tree_oid, name, mode,
    type, child_oid); commits: (oid, tree_oid, parent_oid, author, message, at).
    Each commit gives a new store.
    """

    def __init__(self, files: DataFrame, trees: DataFrame | None = None, commits: DataFrame | None = None, head: str | None = None):
        self.files, self.trees, self.commits, self.head = files, trees, commits, head

    @classmethod
    def create(cls, spark: SparkSession) -> Store:
        return cls(spark.createDataFrame([], "path array<string>, content binary, oid string"))

    @classmethod
    def of(cls, rows: DataFrame, key: Column, content: Column) -> Store:
        data = content.cast("binary")
        return cls(rows.select(F.split(key, "/").alias("path"), data.alias("content"), blob_oid(data).alias("oid")))

    def __len__(self) -> int:
        return self.files.count()

    def get(self, key: str) -> bytes:
        row = self.files.where(F.col("path") == F.array(*map(F.lit, key.split("/")))).first()
        if row is None:
            raise KeyNotFound(key)
        return bytes(row["content"])

    def scan(self, low: Bound = UNBOUNDED, high: Bound = UNBOUNDED, reverse: bool = False) -> DataFrame:
        """Blobs by path, compared component by component; bounds are lists of components."""
        lit = lambda b: Bound(b.kind, F.array(*map(F.lit, b.at)) if b.at is not None else None)
        rows = self.files.where(within(F.col("path"), lit(low), lit(high)))
        return rows.orderBy(F.desc("path") if reverse else F.asc("path"))

    def insert(self, spark: SparkSession, key: str, content: bytes, message: str = "", author: str = "", at: int = 0) -> Store:
        return self.commit(spark, spark.createDataFrame([(0, "ins", key, content)], "seq long, op string, key string, content binary"), message, author, at)

    def remove(self, spark: SparkSession, key: str, message: str = "", author: str = "", at: int = 0) -> Store:
        return self.commit(spark, spark.createDataFrame([(0, "rem", key, None)], "seq long, op string, key string, content binary"), message, author, at)

    def commit(self, spark: SparkSession, ops: DataFrame, message: str = "", author: str = "", at: int = 0) -> Store:
        """A batch of ins and rem (seq, op, key, content); of several for one key the last counts."""
        last = ops.groupBy("key").agg(F.max_by(F.struct("op", "content"), "seq").alias("last")).select(F.split("key", "/").alias("path"), "last.*")
        kept = self.files.join(last, "path", "left_anti")
        new = last.where("op = 'ins'").select("path", "content", blob_oid(F.col("content")).alias("oid"))
        files = kept.unionByName(new)
        clash = files.select(F.explode(prefixes(F.col("path"))).alias("path")).distinct().join(files.select("path"), "path").first()
        if clash is not None:
            raise InvalidInput(f"{'/'.join(clash['path'])} is a file and a folder")
        trees, root = write_trees(files)
        body = f"tree {root}\nparent {self.head or ''}\nauthor {author} {at}\n\n{message}"
        oid = hashlib.sha1(f"commit {len(body.encode())}\0{body}".encode()).hexdigest()
        row = spark.createDataFrame([(oid, root, self.head, author, message, at)], "oid string, tree_oid string, parent_oid string, author string, message string, at long")
        return Store(files, trees if self.trees is None else self.trees.unionByName(trees).distinct(), row if self.commits is None else self.commits.unionByName(row), oid)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def ancestors(self, spark: SparkSession, oid: str | None = None) -> DataFrame:
        """(oid, depth) from a commit back."""
        self.commits.createOrReplaceTempView("_commits")
        return spark.sql(f"""WITH RECURSIVE a(oid, depth) AS (
            SELECT '{oid or self.head}', 0 UNION ALL
            SELECT c.parent_oid, a.depth + 1 FROM a JOIN _commits c ON c.oid = a.oid WHERE c.parent_oid IS NOT NULL)
            SELECT oid, depth FROM a""")

    def checkout(self, folder: str) -> int:
        """Writes all blobs as files below a folder that executors can reach; how many."""

        def write(batches):
            import os

            import pandas as pd

            for b in batches:
                for parts, data in zip(b["path"], b["content"]):
                    place = os.path.join(folder, *parts)
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    with open(place, "wb") as f:
                        f.write(data)
                yield pd.DataFrame({"n": [len(b)]})

        return self.files.select("path", "content").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Transaction:
    """Operations that are staged and committed together."""

    def __init__(self, store: Store):
        self.store, self.ops = store, []

    def insert(self, key: str, content: bytes) -> Transaction:
        self.ops.append((len(self.ops), "ins", key, content))
        return self

    def remove(self, key: str) -> Transaction:
        self.ops.append((len(self.ops), "rem", key, None))
        return self

    def commit(self, spark: SparkSession, message: str = "", author: str = "", at: int = 0) -> Store:
        return self.store.commit(spark, spark.createDataFrame(self.ops, "seq long, op string, key string, content binary"), message, author, at)


def prefixes(parts: Column) -> Column:
    """All proper prefixes of a path but the empty one."""
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.slice(parts, F.lit(1), k))).otherwise(F.array().cast("array<array<string>>"))


def write_trees(files: DataFrame) -> tuple[DataFrame, str]:
    """(all tree edges, oid of the root): trees are hashed from the deepest level up, one aggregation for each level."""
    spark = files.sparkSession
    depth = files.agg(F.coalesce(F.max(F.size("path")), F.lit(0))).first()[0]
    edges = spark.createDataFrame([], "tree_oid string, name string, mode string, type string, child_oid string")
    below = spark.createDataFrame([], "path array<string>, child_oid string")
    for level in range(depth, 0, -1):
        blobs = files.where(F.size("path") == level).select("path", F.col("oid").alias("child_oid"), F.lit("blob").alias("type"))
        nodes = blobs.unionByName(below.select("path", "child_oid", F.lit("tree").alias("type")))
        mode = F.when(F.col("type") == "tree", "40000").otherwise("100644")
        nodes = nodes.select(F.slice("path", F.lit(1), F.size("path") - 1).alias("parent"), F.element_at("path", -1).alias("name"), mode.alias("mode"), "type", "child_oid")
        # Names are ordered as if those of trees ended with a slash.
        order = F.concat(F.col("name"), F.when(F.col("type") == "tree", "/").otherwise("")).cast("binary").alias("order")
        children = F.array_sort(F.collect_list(F.struct(order, "name", "mode", "type", "child_oid"))).alias("c")
        entry = lambda x: F.concat(F.concat(x["mode"], F.lit(" "), x["name"]).cast("binary"), F.unhex(F.lit("00")), F.unhex(x["child_oid"]))
        body = F.aggregate(F.transform("c", entry), F.lit(b""), lambda a, x: F.concat(a, x)).alias("body")
        trees = nodes.groupBy("parent").agg(children).select("parent", "c", body)
        oid = F.sha1(F.concat(F.lit("tree ").cast("binary"), F.octet_length("body").cast("string").cast("binary"), F.unhex(F.lit("00")), F.col("body")))
        trees = trees.select("parent", "c", oid.alias("oid"))
        edges = edges.unionByName(trees.select(F.col("oid").alias("tree_oid"), F.explode("c").alias("e")).select("tree_oid", "e.name", "e.mode", "e.type", "e.child_oid"))
        below = trees.select(F.col("parent").alias("path"), F.col("oid").alias("child_oid"))
    root = below.first() if depth else None
    return edges, root["child_oid"] if root else hashlib.sha1(b"tree 0\0").hexdigest()


# -- prefix trees -------------------------------------------------------------


def trie_set(trie: DataFrame, rows: DataFrame) -> DataFrame:
    """Values (path, value) put in a tree, which is the table of its values; the later of equal paths counts."""
    return trie.join(rows, "path", "left_anti").unionByName(rows)


def trie_remove(trie: DataFrame, paths: DataFrame) -> DataFrame:
    return trie.join(paths, "path", "left_anti")


def trie_get(trie: DataFrame, path: Sequence) -> DataFrame:
    return trie.where(F.col("path") == F.array(*map(F.lit, path)))


def trie_walk(trie: DataFrame, skip_below: DataFrame | None = None) -> DataFrame:
    """All nodes before their children: (path, depth, breadth, value); breadth is a node's place among its siblings.

    Nodes below a path of skip_below are left out, these themselves stay.
    """
    inner = trie.select(F.explode(prefixes(F.col("path"))).alias("path"), F.lit(None).cast(trie.schema["value"].dataType).alias("value"))
    nodes = trie.select("path", "value").unionByName(inner).groupBy("path").agg(F.first("value", True).alias("value"))
    parent = F.slice("path", F.lit(1), F.size("path") - 1)
    siblings = Window.partitionBy(parent).orderBy("path")
    out = nodes.select("path", F.size("path").alias("depth"), (F.row_number().over(siblings) - 1).alias("breadth"), "value")
    if skip_below is not None:
        s = skip_below.select(F.col("path").alias("cut"))
        out = out.join(s, starts_with_path(F.col("path"), F.col("cut")) & (F.size("path") > F.size("cut")), "left_anti")
    return out.orderBy("path")


def excluded(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows (path) that lie below none of the folders (path): an equi-join on the prefix, one for each depth of folder."""
    cuts = folders.select(F.col("path").alias("cut")).distinct()
    heads = rows.select("path", F.explode(F.concat(prefixes(F.col("path")), F.array("path"))).alias("cut"))
    return rows.join(heads.join(cuts, "cut").select("path").distinct(), "path", "left_anti")
