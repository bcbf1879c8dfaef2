"""The pipeline and the queries against brute force, on tables of known contents."""

import itertools
import os

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_operators import AWKWARD, DOCS, docs_of, edited, grams, prose

import __spark_entry__
import corpus_pipeline
from tidemark.llm import entry, mixing, near_dedup

INSULTS = ["grumblefool", "snarkwit", "dolterel"]


def write(spark, folder, rows, labels, bench, clash=False):
    docs_of(spark, rows, clash).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def corpus():
    rows, bench = [], [(k, prose(25 + k, 90_000 + k)) for k in range(8)]
    for k in range(700):
        text = prose(60 + k % 90, 20_000 + k)
        if k % 6 == 0:
            words = text.split()
            for j in range(5):
                words.insert((j * 13 + k) % len(words), INSULTS[(j + k) % 3])
            text = " ".join(words)
        elif k % 25 == 1:
            text = rows[k - 20][1] if k >= 20 else text
        elif k % 25 == 2:
            text = edited(rows[k - 21][1], 0.02, k) if k >= 21 else text
        elif k % 25 == 3:
            text = f"{text} {bench[k % 8][1]} {prose(10, k)}"
        rows.append((k, text, ["web", "web", "web", "books", "code"][k % 5]))
    return rows, {i for i, t, _ in rows if any(w in t for w in INSULTS)}, bench


def brute(rows, bench):
    kept = [r for r in rows if not any(w in r[1] for w in INSULTS)]
    first = {}
    for r in kept:
        first.setdefault(r[1], r)
    kept = list(first.values())
    sets = {r[0]: grams(r[1]) for r in kept}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(sets, 2):
        common = len(sets[x] & sets[y])
        if common and common / len(sets[x] | sets[y]) >= near_dedup.THRESHOLD:
            parent[max(root(x), root(y))] = min(root(x), root(y))
    kept = [r for r in kept if root(r[0]) == r[0]]
    return [r for r in kept if not any(t in r[1] for _, t in bench)]


def test_pipeline_is_brute_force(spark, corpus, tmp_path):
    rows, toxic, bench = corpus
    folder = write(spark, tmp_path, rows, [(k, 1, int(k in toxic)) for k in range(0, 700, 2)] + [(k, 1, int(k in toxic)) for k in range(1, 400, 2)], bench)
    want = brute(rows, bench)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if k < 4:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns
            out.write.parquet(f"{folder}/stage{k}")
            docs = spark.read.parquet(f"{folder}/stage{k}")
            counts.append(docs.count())
    assert all(a > b for a, b in itertools.pairwise(counts))
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {r[0] for r in want}
    sizes = {}
    for r in want:
        sizes[r[2]] = sizes.get(r[2], 0) + 1
    take = mixing.quotas(sizes, mixing.targets(sizes))
    result = corpus_pipeline.run(spark, folder)
    got = result.collect()
    assert {s: sum(r["source"] == s for r in got) for s in take} == take
    texts = {r[0]: r[1] for r in want}
    assert len({r["doc_id"] for r in got}) == len(got) and all(texts[r["doc_id"]] == r["text"] for r in got)
    assert result.columns == [*docs.columns, "shard", "position"]


def test_pipeline_awkward(spark, corpus, tmp_path):
    folder = write(spark, tmp_path, AWKWARD, [(1, 1, 1), (None, None, None), (4, 0, 0)], [(1, None), (None, "x"), (2, "")], clash=True)
    got = corpus_pipeline.run(spark, folder)
    assert got.where("doc_id IS NULL").count() <= 2 and got.count() > 0
    assert got.where(F.col("doc_id").isin(5, 6, 9, 11)).count() == 0


def test_pipeline_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [], [], [])).count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and DOCS


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_queries(spark, name):
    """Each query runs over its whole table; those with SQL give what it gives."""
    df = __spark_entry__.queries()[name](spark, SF)
    rows = df.collect()
    if name in entry.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
        cursor = con.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(map(repr, cursor.fetchall()))
