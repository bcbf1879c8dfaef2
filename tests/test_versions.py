"""Version algebra and folds against a sequential model, with golden chains and random logs."""

import os
import random
import subprocess
import sys
from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import index as I
from tidemark.operators import oplog
from tidemark.operators import versions as V
from tidemark.plans.model import MONO, UNBOUNDED, Cutoff, InvalidCAS, InvalidInput, KeyNotFound, NotSupported, excluded, included, mutation_schema, version_schema

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
GOLDEN = [(1, 17), (2, 34), (3, 21), (4, None), (5, 90), (6, None), (7, None), (8, 43)]
OTHER = [(2, 61), (4, 7), (6, None), (8, 12), (10, None), (12, 88), (14, 3), (16, None)]


def table(spark, chain, key=7):
    return spark.createDataFrame([(key, s, None if v is None else float(v), v is None) for s, v in chain], version_schema())


def rows(df):
    return sorted(map(tuple, df.select("key", "seqno", "value", "deleted").collect()), key=repr)


def random_log(seed, n=400, keys=12):
    r = random.Random(seed)
    return [(k + 1, r.choice(["set", "insert", "insert", "delete", "remove"]), r.randrange(keys), float(r.randrange(1000)), None) for k in range(n)]


def model(log):
    m = oplog.Model()
    for seqno, op, key, value, cas in log:
        try:
            m.apply(op, key, value, cas, seqno)
        except InvalidCAS:
            pass
    return sorted(m.rows(), key=repr)


def test_golden_chain_round_trip(spark):
    t = table(spark, GOLDEN)
    packed = V.packed(t)
    assert packed.first()["value"]["value"] == 43 and len(packed.first()["deltas"]) == 7
    assert rows(V.unpacked(packed)) == rows(t)
    cents = t.withColumn("value", t["value"].cast("long"))
    assert rows(V.unpacked(V.encoded(cents, lambda n, o: n - o), lambda n, d: n - d)) == rows(cents)
    assert rows(V.unpacked(V.drain_deltas(packed))) == [(7, 8, 43.0, False)]


def test_contains_and_interleave(spark):
    a, b = table(spark, GOLDEN), table(spark, OTHER)
    assert V.contains(a, table(spark, [(1, 17), (7, None)]))
    assert not V.contains(a, table(spark, [(2, 17)]))
    both = V.interleave(a, b)
    assert both.count() == 16 and V.contains(both, a) and V.contains(both, b)
    with pytest.raises(InvalidInput):
        V.append(b, a)
    assert V.append(table(spark, [(9, 1)]), a).count() == 9


@pytest.mark.parametrize("seed", range(3))
def test_folds_follow_the_model(spark, seed):
    log = random_log(seed)
    df = spark.createDataFrame(log, mutation_schema())
    want = model(log)
    assert rows(oplog.fold(df)) == want
    assert rows(oplog.cas_fold(df)) == want
    assert rows(oplog.fold_latest(df)) == rows(V.latest(oplog.fold(df)))
    mid = 200
    older, newer = (oplog.fold(df.where(c)) for c in (f"seqno <= {mid}", f"seqno > {mid}"))
    assert older.count() + newer.count() == V.merge(newer, older).count()


def test_cas(spark):
    log = [(1, "insert", 1, 5.0, 0), (2, "insert", 1, 6.0, 0), (3, "insert", 1, 7.0, 1), (4, "delete", 2, None, 9), (5, "remove", 1, None, 3), (6, "set", 1, 8.0, 0)]
    assert rows(oplog.cas_fold(spark.createDataFrame(log, mutation_schema()))) == [(1, 6, 8.0, False)]
    index = I.Index.empty("t", spark)
    index, at, old = I.write_one(index, spark, "insert", 7, 1.0)
    assert (at, old) == (1, None)
    with pytest.raises(InvalidCAS):
        I.write_one(index, spark, "set", 7, 2.0, cas=5)
    index, at, old = I.write_one(index, spark, "delete", 7, cas=1)
    assert at == 2 and old[0] == 1 and index.get(7)["deleted"] and index.deleted_count() == 1 and len(index) == 1
    index, at, old = I.write_one(index, spark, "remove", 9)
    assert at == 2 and old is None
    with pytest.raises(KeyNotFound):
        index.get(9)
    with pytest.raises(NotSupported):
        I.Index("s", index.versions, read_only=True).commit(index.versions)


@pytest.mark.parametrize("value,kind", [(2**53 + 1, "long"), (float("nan"), "double"), (b"\x00\xff", "binary"), ("é", "string"), (None, "double")])
def test_folds_keep_values(spark, value, kind):
    log = [(1, "insert", 1, value, None), (2, "delete", 1, None, 1), (3, "insert", 1, value, 1), (4, "insert", 1, value, 2), (5, "insert", 2, None, None)]
    df = spark.createDataFrame(log, f"seqno long, op string, key long, value {kind}, cas long")
    want = repr(sorted([(1, 1, value, False), (1, 2, None, True), (1, 4, value, False), (2, 5, None, False)], key=repr))
    assert repr(rows(oplog.cas_fold(df)).copy()).replace("bytearray", "") == want.replace("bytearray", "")
    again = [(1, 1, value, False), (1, 2, None, True), (1, 3, value, False), (2, 4, None, False)]
    later = df.withColumn("cas", F.when(F.col("seqno") == 3, 7))  # fails, so later ones get other numbers
    assert repr(rows(oplog.sequential_fold(later, "seqno"))) == repr(sorted(again, key=repr))
    assert rows(oplog.sequential_fold(df.drop("cas").withColumn("cas", F.lit(None).cast("long")), "seqno")).__len__() == 5


@pytest.mark.parametrize("seed", range(3))
def test_sequential_fold_gives_numbers_in_turn(spark, seed):
    log = random_log(seed, 300)
    m = oplog.Model(50)
    for _, op, key, value, _ in log:
        m.apply(op, key, value)
    df = spark.createDataFrame(log, mutation_schema())
    assert rows(oplog.sequential_fold(df, "seqno", 50)) == sorted(m.rows(), key=repr)
    # With a compare-and-set that always fails for one key, in one task.
    m = oplog.Model(0)
    for _, op, key, value, _ in log:
        if key != 5:
            m.apply(op, key, value)
    assert rows(oplog.sequential_fold(df.withColumn("cas", F.when(F.col("key") == 5, 10**9)), "seqno")) == sorted(m.rows(), key=repr)


def test_workers_find_the_package():
    """From another working directory, without this folder on the path of Python workers."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from tidemark import catalog
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for n in ("cas_fold", "html_text_lines"):
    assert catalog.queries()[n](s, {SF!r}).count() > 0
print("found")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("found"), done.stderr[-3000:]


@pytest.mark.parametrize("query", ["iter_latest", "level_winner_nway", "y_get_first_level", "asof_seqno"])
def test_latest_is_a_hash_aggregate(spark, query):
    plan = catalog.queries()[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("at", [0, 60, 200, 399])
@pytest.mark.parametrize("kind", ["lsm", "tombstone"])
def test_compaction(spark, at, kind):
    t = oplog.fold(spark.createDataFrame(random_log(5), mutation_schema()))
    data = rows(t)
    tip = {k: max(r[1] for r in data if r[0] == k) for k, *_ in data}
    gone = {k for k, s, _, d in data if s == tip[k] and d}
    for bound, inside in ((included(at), lambda s: s <= at), (excluded(at), lambda s: s < at), (UNBOUNDED, lambda s: True)):
        want = [r for r in data if not inside(r[1])] if kind == "lsm" else [r for r in data if not (r[0] in gone and inside(tip[r[0]]))]
        cut = Cutoff(kind, bound)
        if cut.noop:
            want = data
        got = V.compact(t, cut)
        assert rows(got) == want
        assert rows(V.compact(got, cut)) == want
    assert rows(V.compact(t, MONO)) == [r for r in data if r[1] == tip[r[0]] and not r[3]]


def test_commit_rules(spark):
    old = table(spark, [(1, 1), (2, 2)]).unionByName(table(spark, [(3, 3)], 11))
    new = table(spark, [(4, 4), (5, None)]).unionByName(table(spark, [(6, 6), (7, 7)], 11)).unionByName(table(spark, [(8, 8), (9, 9)], 12))
    got = rows(oplog.commit(old, new, versions=False))
    assert got == sorted([(7, 1, 1.0, False), (7, 2, 2.0, False), (7, 5, None, True), (11, 7, 7.0, False), (12, 8, 8.0, False), (12, 9, 9.0, False)], key=repr)
    with pytest.raises(InvalidInput):
        I.Index("t", old).commit(table(spark, [(3, 1)]))
    assert rows(oplog.sticky(table(spark, GOLDEN[:4]))) == [(7, 4, None, True)]


def test_violations(spark):
    bad = spark.createDataFrame([(1, 1, 1.0, False), (1, 1, 2.0, False), (2, 0, 1.0, False), (3, 2, 1.0, True), (4, 99, 1.0, False)], version_schema())
    assert sorted(r["problem"] for r in I.violations(bad, 50).collect()) == ["repeated seqno", "seqno below 1", "seqno beyond the table's", "tombstone with a value"]


def test_violations_of_repeated_rows(spark):
    """A seqno is reported once however often it is repeated, other problems for every row, also beside it."""
    bad = spark.createDataFrame([(1, 5, 1.0, False)] * 3 + [(2, 0, None, False)] * 2 + [(None, 3, 1.0, False)] * 2 + [(4, None, 1.0, False), (5, 8, 1.0, True), (5, 8, None, True)], version_schema())
    want = [(1, 5, "repeated seqno"), (2, 0, "repeated seqno"), (None, 3, "repeated seqno"), (5, 8, "repeated seqno"), (4, None, "seqno below 1"), (5, 8, "tombstone with a value")] + [(2, 0, "seqno below 1"), (None, 3, "no key")] * 2
    assert sorted(map(tuple, I.violations(bad).collect()), key=repr) == sorted(want, key=repr)


def test_violations_of_many_equal_rows(spark):
    """More rows of one seqno than are listed at once; they are summed up before the shuffle."""
    bad = I.violations(spark.range(25_000).selectExpr("cast(null AS long) AS key", "7L AS seqno", "1.0D AS value", "false AS deleted"))
    assert {r["problem"]: r["count"] for r in bad.groupBy("problem").count().collect()} == {"no key": 25_000, "repeated seqno": 1}
    plan = bad._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("partial_count(1)")


def test_violations_go_through_the_table_once(spark):
    """A union of readings has the log folded and sorted several times by the same tasks."""
    log = spark.createDataFrame(random_log(1), mutation_schema())
    for df in (I.violations(oplog.fold(log)), catalog.queries()["validate"](spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "Union" not in plan


def test_planted_problems_of_an_odd_log(spark, tmp_path):
    """Repeated events, and events without a user or an id: one row with seqno 0 a key, and the problems of what is repeated already."""
    events = [(k, k % 7 or None, "click", 1.0) for k in range(400)] + [(88, 88 % 7, "click", 1.0), (None, 3, "click", 1.0)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    rows = [(u, e + 1, 1.0, False) for e, u, *_ in events if e is not None]
    table = rows + [r for r in rows if r[1] % 97 == 0] + [(u, 0, 1.0, False) for u in {r[0] for r in rows if r[1] % 89 == 0}] + [(u, s + 1_000_000_000, 1.0, True) for u, s, *_ in rows if s % 83 == 0]
    want = [(*k, "repeated seqno") for k, n in Counter((u, s) for u, s, *_ in table).items() if n > 1]
    for u, s, _, gone in table:
        if u is None or s < 1 or gone:
            want.append((u, s, "no key" if u is None else "seqno below 1" if s < 1 else "tombstone with a value"))
    assert sorted(map(tuple, catalog.queries()["validate"](spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    t = spark.createDataFrame([], version_schema())
    for df in (V.latest(t), V.compact(t, MONO), V.merge(t, t), V.level_winner([t, t]), oplog.commit(t, t, False), I.scan(t)):
        assert df.count() == 0
    assert I.stats(t).first()["n_count"] == 0 and I.Index("t", t).is_empty() and I.Index("t", t).first() is None
