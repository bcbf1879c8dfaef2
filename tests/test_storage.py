"""Snapshots, levels, logs, filters, shards, streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import index as I
from tidemark.operators import membership, oplog, shards, snapshot, stats
from tidemark.operators import versions as V
from tidemark.plans.model import MONO, UNBOUNDED, Cutoff, InvalidFile, InvalidInput, excluded, included, whole_range
from tidemark.sources import wal
from tidemark.streaming import stages


def rows(df):
    return sorted(map(tuple, df.select("key", "seqno", "value", "deleted").collect()), key=repr)


def test_snapshots(spark, tmp_path):
    old = oplog.fold(oplog.random_log(spark, 1, 50, 100, 20, 10, 40))
    new = oplog.fold(oplog.random_log(spark, 2, 0, 80, 20, 0, 40, seqno=500))
    s = snapshot.build(old, str(tmp_path / "0"), snapshot.Config("t"), seqno=180, metadata=b"mine")
    s.validate(spark)
    again = snapshot.open_snapshot(spark, str(tmp_path / "0"))
    assert again.stats == s.stats and again.metadata == b"mine" and rows(again.table(spark)) == rows(old) and again.footprint(spark) > 0
    t = snapshot.incremental(spark, again, new, str(tmp_path / "1"))
    assert rows(t.table(spark)) == rows(V.merge(new, old)) and not t.is_compacted()
    c = snapshot.compact(spark, t, str(tmp_path / "2"), MONO)
    assert c.is_compacted() and rows(c.table(spark)) == rows(V.compact(t.table(spark), MONO))
    flat = snapshot.build(old, str(tmp_path / "3"), snapshot.Config("t", delta_ok=False))
    assert rows(flat.table(spark)) == rows(V.latest(old))
    assert s.stats["n_count"] == V.latest(old).count() == len(s) and s.stats["n_versions"] == old.count() and len(s.files(spark)) >= 1
    unlock = c.lock(spark)
    with pytest.raises(InvalidInput, match="in use"):
        c.purge(spark)
    unlock()
    c.purge(spark)
    with pytest.raises(InvalidFile):
        snapshot.open_snapshot(spark, c.path)


@pytest.mark.parametrize("kind", ["none", "bloom", "xor8", "fuse"])
def test_snapshot_filters(spark, tmp_path, kind):
    """Filters are built with the snapshot and asked by reads."""
    t = oplog.fold(oplog.random_log(spark, 3, 300, 200, 50, 30, 400))
    s = snapshot.build(t, str(tmp_path / "s"), snapshot.Config("t", filter=kind))
    s.validate(spark)
    s = snapshot.open_snapshot(spark, str(tmp_path / "s"))
    some = rows(V.latest(t))[:5]
    assert rows(s.get(spark, some[0][0])) == some[:1] and s.get(spark, 10**9).count() == 0
    keys = spark.createDataFrame([(r[0],) for r in some] + [(k,) for k in range(5000, 5400)], "key long")
    assert rows(s.get_all(spark, keys)) == some
    if kind != "none":
        passed = membership.maybe(keys.select(F.xxhash64("key").alias("digest")), s.filters(spark)).count()
        assert 5 <= passed < 5 + 20
        spark.read.parquet(f"{s.path}/data").limit(0).selectExpr("0 AS bucket", "1 AS buckets", "'x' AS kind", "X'00' AS data").write.mode("overwrite").parquet(f"{s.path}/filter")
        with pytest.raises(InvalidFile, match="filter"):
            s.validate(spark)


def test_snapshot_order_is_validated(spark, tmp_path):
    t = oplog.fold(oplog.random_log(spark, 3, 100, 100, 20, 10, 90))
    s = snapshot.build(t, str(tmp_path / "s"), snapshot.Config("t"))
    kept = spark.createDataFrame(t.collect(), t.schema)
    kept.coalesce(1).sortWithinPartitions(F.desc("key")).write.mode("overwrite").parquet(f"{s.path}/data")
    with pytest.raises(InvalidFile, match="in order"):
        s.validate(spark)
    kept.repartition(3).sortWithinPartitions("key", "seqno").write.mode("overwrite").parquet(f"{s.path}/data")
    with pytest.raises(InvalidFile, match="another file"):
        s.validate(spark)


@pytest.mark.parametrize("delta_ok", [True, False])
def test_tree(spark, tmp_path, delta_ok):
    """Writes, flushes and merges in any order read as the table that all writes make."""
    r = random.Random(9)
    tree = snapshot.Tree(spark, str(tmp_path), snapshot.Config("t", delta_ok=delta_ok))
    every = None
    for k in range(7):
        batch = oplog.fold(oplog.random_log(spark, k, 0, r.choice([5, 60]), 10, 0, 30, seqno=1000 * k))
        every = batch if every is None else every.unionByName(batch)
        tree.write(batch)
        if k % 3 != 2:
            assert tree.flush() is not None and tree.flush() is None
            while tree.compact() is not None:
                pass
        assert rows(tree.read().iter()) == rows(V.latest(every))
        if delta_ok:
            assert rows(tree.read().iter_versions()) == rows(every)
    key = rows(every)[0][0]
    assert rows(tree.read().get(key)) == rows(V.latest(every.where(F.col("key") == key)))
    sizes = [s for s in tree.sizes() if s is not None]
    assert all(a < snapshot.Levels.RATIO * b for a, b in zip(sizes, sizes[1:])) and len(list(tmp_path.iterdir())) == len(sizes)


def test_tree_cutoff_and_shards(spark, tmp_path):
    tree = snapshot.Tree(spark, str(tmp_path / "t"), snapshot.Config("t"))
    one, two = oplog.fold(oplog.random_log(spark, 1, 0, 60, 20, 0, 20)), oplog.fold(oplog.random_log(spark, 2, 0, 60, 20, 0, 20, seqno=500))
    tree.write(one)
    tree.levels[5] = snapshot.build(one, str(tmp_path / "five"), tree.config)
    tree.memory = tree.empty
    tree.levels[4] = snapshot.build(two, str(tmp_path / "four"), tree.config)
    assert tree.compact(MONO) == 5 and rows(tree.read().iter_versions()) == rows(V.compact(one.unionByName(two), MONO))
    t = oplog.fold(oplog.random_log(spark, 1, 300, 0, 0, 0, 300))
    low, high = shards.split(t, 20)
    parts = [snapshot.build(x, str(tmp_path / f"p{k}"), tree.config) for k, x in enumerate((low, high))]
    new = snapshot.reshard(spark, parts, str(tmp_path / "new"))
    assert abs(len(new[0]) - len(new[1])) <= 1 and sum(map(len, new)) == V.latest(t).count()
    assert snapshot.reshard(spark, new, str(tmp_path / "none")) is new and not (tmp_path / "none").exists()


def test_levels():
    L = snapshot.Levels
    assert L.commit_level(10, [None, None, 50]) == 1
    assert L.commit_level(30, [None, None, 50]) == 2
    assert L.commit_level(1, [None, None]) == 1
    assert L.compact_levels([None, 30, 50]) == ([1, 2], 2)
    assert L.compact_levels([None, 10, 50]) is None
    levels = L([])
    assert levels.cutoff(False, 0, 5) is None and levels.cutoff(True, 0, 5).kind == "tombstone" and levels.cutoff(True, 1, 5).kind == "lsm"
    assert L([], lsm=False).cutoff(True, 0, 5) == MONO
    assert snapshot.advance(None, Cutoff("lsm"), 9) == Cutoff("lsm", included(9))
    with pytest.raises(InvalidInput):
        snapshot.advance(Cutoff("lsm", included(9)), Cutoff("lsm", included(5)), 20)
    assert snapshot.rebalance([100, 100, 10, 200]) == [2, 3]


def test_wal(spark, tmp_path):
    log = wal.Wal.create(spark, str(tmp_path), "my-log")
    ops = spark.range(100).select(F.col("id").alias("at"), F.concat(F.lit("op"), "id").alias("op"))
    assert log.append(spark, ops, "at") == 100
    assert log.append(spark, ops.limit(10), "at") == 110
    again = wal.Wal.load(spark, str(tmp_path), "my-log")
    assert (again.last, again.number) == (110, 1)
    assert [r["seqno"] for r in again.iter(spark).collect()] == list(range(1, 111))
    assert bytes(again.iter(spark).first()["op"]) == b"op0"
    assert again.read(spark, excluded(5), included(9)).count() == 4
    assert again.read(spark, excluded(2**63 - 1), UNBOUNDED).count() == 0 and again.read(spark, UNBOUNDED, excluded(0)).count() == 0
    assert again.replay_from(spark, 105).count() == 5
    assert wal.parse_journal("a-b-journal-012.parquet") == ("a-b", 12) and wal.parse_journal("x.parquet") is None
    assert whole_range(excluded(3), excluded(4)) is None


def test_wal_rotates(spark, tmp_path):
    log = wal.Wal.create(spark, wal.Config(str(tmp_path), "r", journal_limit=2000))
    for k in range(4):
        log.append(spark, spark.range(k * 100, k * 100 + 100).select(F.col("id").alias("at"), F.sha1(F.col("id").cast("string")).alias("op")), "at")
    assert (log.last, log.number) == (400, 4)
    assert [(j.number, j.state, j.first, j.last) for j in log.describe(spark)] == [(k + 1, "archive", 100 * k + 1, 100 * k + 100) for k in range(4)]
    assert log.purge_till(spark, 250) == 2 and log.read(spark).count() == 200
    again = wal.Wal.load(spark, wal.Config(str(tmp_path), "r", journal_limit=1 << 20), state=(0, 0), add=lambda s, seqno, op: (s[0] + 1, max(s[1], seqno)))
    assert again.state == (200, 400) and again.last == 400
    assert again.append(spark, spark.range(5).select(F.col("id").alias("at"), F.lit("x").alias("op")), "at") == 405
    assert again.describe(spark)[-1].state == "working" and again.fold(spark, 0, lambda s, *_: s + 1, after=398) == 7


def test_wal_streams_after_appends(spark, tmp_path):
    """A stream keeps what was appended, runs on after a restart, and a batch that is run again replaces itself only."""
    log = wal.Wal.create(spark, str(tmp_path / "log"))
    log.append(spark, spark.range(10).select(F.col("id").alias("at"), F.lit("a").alias("op")), "at")
    data = str(tmp_path / "in")
    for lo, hi in ((11, 14), (14, 20)):
        spark.range(lo, hi).coalesce(1).write.mode("append").parquet(data)
        stream = stages.from_files(spark, data, "id long", 1).select(F.col("id").alias("seqno"), F.lit(b"s").alias("op"))
        stages.close_wait(log.stream(spark, stream, str(tmp_path / "c"), once=True))
    again = wal.Wal.load(spark, str(tmp_path / "log"))
    assert [r["seqno"] for r in again.iter(spark).collect()] == list(range(1, 20)) and again.last == log.last == 19
    again.append(spark, spark.range(3).select(F.col("id").alias("at"), F.lit("b").alias("op")), "at")
    assert again.read(spark).count() == 22 and again.read(spark).where("op = X'61'").count() == 10
    # The last batch is run again.
    commits = sorted((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (tmp_path / "c" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    stages.close_wait(again.stream(spark, stages.from_files(spark, data, "id long", 1).select(F.col("id").alias("seqno"), F.lit(b"s").alias("op")), str(tmp_path / "c"), once=True))
    assert sorted(r["seqno"] for r in again.read(spark).collect()) == list(range(1, 23))


def test_wal_replays(spark, tmp_path):
    log = wal.Wal.create(spark, str(tmp_path))
    ops = [f"{op},{key},{value}" for op, key, value in (("set", 1, 5), ("insert", 1, 6), ("delete", 2, 0), ("remove", 1, 0), ("insert", 3, 7))]
    log.append(spark, spark.createDataFrame(list(enumerate(ops)), "at int, op string"), "at")

    def mutations(records):
        part = F.split(F.col("op").cast("string"), ",")
        return records.select("seqno", part[0].alias("op"), part[1].cast("long").alias("key"), part[2].cast("double").alias("value"), F.lit(None).cast("long").alias("cas"))

    index = log.replay(spark, I.Index.empty("t", spark), mutations)
    assert rows(index.versions) == [(2, 3, None, True), (3, 5, 7.0, False)]
    log.append(spark, spark.createDataFrame([(0, "insert,3,8")], "at int, op string"), "at")
    assert rows(log.replay(spark, index, mutations).versions) == [(2, 3, None, True), (3, 5, 7.0, False), (3, 6, 8.0, False)]


def test_streams_stop(spark, tmp_path):
    """What follows a stop is neither handed on nor lost."""
    data = str(tmp_path / "in")
    for k in range(4):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(data)
    got, ends = [], []

    def sink(rows, _):
        got.extend(r["id"] for r in rows.collect())
        return len(got) >= 40

    stream = lambda: stages.from_files(spark, data, "id long", 1)
    first = stages.run(stream(), sink, str(tmp_path / "c"), finish=lambda: ends.append(1))
    stages.close_wait(first)
    first.close_wait()
    assert len(got) == 10 and ends == [1]
    for n in (20, 30, 40, 40):
        stages.close_wait(stages.run(stream(), sink, str(tmp_path / "c")))
        assert len(got) == n
    assert sorted(got) == list(range(40))

    def bad(rows, _):
        raise ValueError("no")

    with pytest.raises(Exception, match="ValueError"):
        stages.close_wait(stages.run(stream(), bad, str(tmp_path / "c2")))


def test_streams_of_iterators(spark, tmp_path):
    it = stages.from_iter(spark, ((k, f"m{k}") for k in range(25)), "id long, text string", str(tmp_path / "i"), chunk=10)
    out = []
    stages.close_wait(stages.fold(it, (0, ""), lambda s, r: (s[0] + r["id"], max(s[1], r["text"])), lambda a, b: (a[0] + b[0], max(a[1], b[1])), out.append, str(tmp_path / "c")))
    assert out == [(300, "m9")]
    gen = stages.from_gen(spark, lambda k: (k,) if k < 7 else None, "id long", str(tmp_path / "g"))
    n = []
    stages.close_wait(stages.fold(gen, 0, lambda s, r: s + 1, lambda a, b: a + b, n.append, str(tmp_path / "d")))
    empty = stages.from_iter(spark, [], "id long", str(tmp_path / "e"))
    stages.close_wait(stages.fold(empty, 0, lambda s, r: s + 1, lambda a, b: a + b, n.append, str(tmp_path / "f")))
    assert n == [7, 0]


def test_running_and_caches(spark):
    r = random.Random(4)
    data = [(k, r.choice([1, 5, 9]), r.random()) for k in range(300)]
    df = spark.createDataFrame(data, "key long, size long, x double")
    total, want = 0, {}
    for k, size, _ in sorted(data, key=lambda t: t[2]):
        total += size
        want[k] = total
    assert {q["key"]: q["t"] for q in shards.running(df, ["x"], t=F.col("size")).collect()} == want
    entries = spark.createDataFrame([(k, f"2024-01-01 00:00:{k:02d}", 10, k == 3) for k in range(20)], "key long, last_access string, size long, deleted boolean")
    gone = {q["key"] for q in shards.evicted(entries, 8, 1000, "2024-01-01 00:00:20", 15).collect()}
    assert gone == {3} | set(range(12))
    assert {q["key"] for q in shards.evicted(entries, 100, 50, "2024-01-01 00:00:20", 100).collect()} == {3} | set(range(15))
    trace = [(k, r.randrange(8), r.choice(["get", "get", "set", "delete"])) for k in range(400)]
    held, n = [], dict.fromkeys(("gets", "sets", "deleted", "evicted", "hits"), 0)
    for _, key, op in trace:
        if op == "get":
            n["gets"] += 1
            n["hits"] += key in held
            held = [x for x in held if x != key] + [key] * (key in held)
        elif op == "set":
            n["sets"] += 1
            held = [x for x in held if x != key] + [key]
            n["evicted"] += len(held) > 3
            held = held[-3:]
        else:
            n["deleted"] += key in held
            held = [x for x in held if x != key]
    assert shards.cache_stats(spark.createDataFrame(trace, "seq long, key long, op string"), 3).first().asDict() == n


def test_filters(spark):
    keys = spark.range(5000).select(membership.digest("id").alias("digest"))
    folded = keys.select(membership.folded(F.col("digest")).alias("digest"))
    sets = membership.bitmaps(folded)
    assert membership.contains(folded, sets).where("NOT found").count() == 0
    assert membership.cardinality(sets).first()["n"] == folded.distinct().count()
    assert rows_of(membership.cardinality(membership.union(sets, sets))) == rows_of(membership.cardinality(sets))
    b = membership.bloom(keys, "digest", membership.Bloom.sized(5000))
    have = [r[0] for r in keys.collect()]
    assert b.contains(have).all()
    other = [r[0] for r in spark.range(5000, 10000).select(membership.digest("id")).collect()]
    assert b.contains(other).mean() < 0.05
    assert membership.Bloom.from_bytes(b.to_bytes()).contains(have[:9]).all()


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("n,k", [(10, 4), (0, 3), (3, 7), (20, 1), (5, 0)])
def test_shards(spark, n, k):
    got = shards.as_shards(spark.range(n).select(F.col("id").alias("key")), k).orderBy("key").collect()
    want = []
    for i in range(k):
        want += [i] * (n // k + (i < n % k))
    assert [r["shard"] for r in got] == want


def test_ranges(spark):
    ranges = shards.high_keys_to_ranges([excluded(10), excluded(20)])
    got = spark.createDataFrame([(k,) for k in (5, 10, 25)], "key long").select(shards.by_ranges(F.col("key"), ranges).alias("p")).collect()
    assert [r["p"] for r in got] == [0, 1, None]


def test_statistics(spark):
    r = random.Random(3)
    values = [r.random() * 1000 for _ in range(777)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert stats.nearest_rank(df, "v").first()["value"] == sorted(values)[int(777 * 0.99)]
    counts = {}
    for v in values:
        counts[min(int(v // 10), 49)] = counts.get(min(int(v // 10), 49), 0) + 1
    want, total, before = [], 0, 90
    for b in sorted(counts):
        total += counts[b]
        p = total * 100 // 777
        if p > before:
            want.append((p, b))
            before = p
    assert sorted(map(tuple, stats.percentiles(stats.histogram(df, "v", 10, 50)).collect())) == want


def test_streams(spark, tmp_path):
    data = str(tmp_path / "in")
    spark.range(100).write.parquet(data)
    stream = stages.from_files(spark, data, "id long")
    got = []
    q = stages.run(stages.reduce_(stream.where("id % 2 = 0"), n=F.count("*"), total=F.sum("id")), lambda rows, _: got.extend(map(tuple, rows.collect())), str(tmp_path / "c1"), complete=True)
    stages.close_wait(q)
    assert got[-1] == (50, 2450)
    one, two = [], []
    q = stages.split(stages.filter_map(stream, "x", F.when(F.col("id") > 97, F.col("id"))), [lambda r, _: one.extend(r.collect()), lambda r, _: two.extend(r.collect())], str(tmp_path / "c2"))
    stages.close_wait(q)
    assert sorted(r["x"] for r in one) == sorted(r["x"] for r in two) == [98, 99]
    stages.close_wait(stages.drain(stream, str(tmp_path / "c3")))
    log = wal.Wal.create(spark, str(tmp_path / "log"))
    q = log.stream(spark, stream.select((F.col("id") + 1).alias("seqno"), F.lit(b"x").alias("op")), str(tmp_path / "c4"), once=True)
    stages.close_wait(q)
    assert wal.Wal.load(spark, str(tmp_path / "log")).last == 100


@pytest.mark.parametrize("n", [0, 1, 2, 50, 3000])
@pytest.mark.parametrize("kind,rate", [("xor8", 0.008), ("fuse", 0.001), ("bloom", 0.03), ("none", 1)])
def test_filter_kinds(kind, rate, n):
    r = np.random.default_rng(n)
    keys, other = r.integers(0, 2**63, n).view(np.uint64), r.integers(0, 2**63, 50_000).view(np.uint64)
    cls = membership.KINDS[kind]
    f = cls.from_bytes(cls.build(keys).to_bytes())
    assert f.contains(keys).all() and f.contains(other).mean() <= rate and all(int(k) in f for k in keys[:3])
    if kind == "xor8":
        assert f.cells.itemsize == 1 and len(f.cells) <= 1.3 * n + 64


@pytest.mark.parametrize("bits,rate", [(8, 0.008), (16, 0.0003)])
def test_fuse(bits, rate):
    r = np.random.default_rng(bits)
    keys, other = r.integers(0, 2**63, 3000).view(np.uint64), r.integers(0, 2**63, 100_000).view(np.uint64)
    f = membership.BinaryFuse.from_bytes(membership.BinaryFuse.build(keys, bits).to_bytes())
    assert f.contains(keys).all() and f.contains(other).mean() < rate and int(keys[0]) in f
