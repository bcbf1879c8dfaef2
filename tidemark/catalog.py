"""All queries over the versioned-table operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import html as H
from tidemark.functions import scalars as X
from tidemark.operators import index as I
from tidemark.operators import membership, objects, oplog, shards, snapshot, stats
from tidemark.operators import versions as V
from tidemark.plans.model import MONO, UNBOUNDED, Bound, Cutoff, excluded, included, within
from tidemark.session import ready, scratch, settle
from tidemark.sources import wal, zim
from tidemark.streaming import stages

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

LOG = """m AS (
    SELECT user_id AS key, event_id + 1 AS seqno, value,
           CASE event_type WHEN 'signup' THEN 'set' WHEN 'view' THEN 'delete' WHEN 'error' THEN 'remove' ELSE 'insert' END AS op
    FROM events)"""


def _fold(name: str = "v", source: str = "m", where: str = "true") -> str:
    return f"""{name} AS (
    SELECT key, seqno, CASE WHEN op = 'delete' THEN NULL ELSE value END AS value, op = 'delete' AS deleted FROM (
        SELECT *, coalesce(max(seqno) FILTER (op = 'set') OVER k, 0) AS ls, coalesce(max(seqno) FILTER (op = 'remove') OVER k, 0) AS lr
        FROM {source} WHERE {where} WINDOW k AS (PARTITION BY key))
    WHERE op <> 'remove' AND seqno >= ls AND seqno > lr)"""


def _tip(name: str = "t", source: str = "v") -> str:
    return f"{name} AS (SELECT key, seqno, value, deleted FROM {source} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seqno DESC) = 1)"


BASE = f"WITH {LOG}, {_fold()}, {_tip()} "


def _add(sql: str | None = None):
    def wrap(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return wrap


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return oplog.from_events(_t(spark, d, "events"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return oplog.fold(_log(spark, d))


def _middle(spark: SparkSession, d: str) -> int:
    return _log(spark, d).agg(F.max("seqno")).first()[0] // 2


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(newer, older): what the two halves of the log leave, each by itself."""
    log, mid = _log(spark, d), _middle(spark, d)
    return oplog.fold(log.where(F.col("seqno") > mid)), oplog.fold(log.where(F.col("seqno") <= mid))


def _share(spark: SparkSession, d: str, tenths: int) -> int:
    """The seqno at so many tenths of the log, so that bounds hold a share of it at every size."""
    return _log(spark, d).agg(F.max("seqno")).first()[0] * tenths // 10


def _at(tenths: int) -> str:
    return f"(SELECT max(event_id + 1) * {tenths} // 10 FROM events)"


def _through(spark: SparkSession, name: str, make: Callable[[str], DataFrame]) -> DataFrame:
    """What make(folder) gives, kept when the folder goes."""
    with scratch(ready(spark), name) as folder:
        return settle(make(folder))


HALF = "(SELECT max(seqno) // 2 FROM m)"
HALVES = f"WITH {LOG}, {_fold('a', 'm', f'seqno > {HALF}')}, {_fold('b', 'm', f'seqno <= {HALF}')}, {_tip('a_tip', 'a')}, {_tip('b_tip', 'b')} "

# -- reads --


@_add(BASE + "SELECT * FROM t")
def iter_latest(spark, d):
    return I.ordered(oplog.fold_latest(_log(spark, d)))


@_add(BASE + "SELECT * FROM t WHERE key = 42")
def get_latest(spark, d):
    return oplog.fold_latest(_log(spark, d).where("key = 42"))


@_add(BASE + "SELECT * FROM v WHERE key = 42")
def get_versions_exploded(spark, d):
    return oplog.fold(_log(spark, d).where("key = 42"))


@_add(BASE + "SELECT * FROM v")
def iter_versions(spark, d):
    return I.ordered(_versions(spark, d))


@_add(BASE + "SELECT * FROM t WHERE key >= 20 AND key < 60")
def range_incl_excl(spark, d):
    return I.ordered(oplog.fold_latest(_log(spark, d).where(within(F.col("key"), included(20), excluded(60)))))


@_add(BASE + "SELECT * FROM t WHERE key > 20 AND key <= 60")
def range_excl_incl(spark, d):
    return I.ordered(oplog.fold_latest(_log(spark, d).where(within(F.col("key"), excluded(20), included(60)))))


@_add(BASE + "SELECT * FROM v WHERE key < 60")
def range_versions(spark, d):
    return I.scan(_versions(spark, d), UNBOUNDED, excluded(60), history=True)


@_add(BASE + "SELECT * FROM t WHERE key >= 20")
def reverse_range(spark, d):
    return I.scan(_versions(spark, d), included(20), UNBOUNDED, reverse=True)


@_add(BASE + "SELECT * FROM v WHERE key > 100")
def reverse_versions(spark, d):
    return I.scan(_versions(spark, d), excluded(100), UNBOUNDED, reverse=True, history=True)


def _orders(spark, d) -> DataFrame:
    """Orders as a table of one version each."""
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") + 1).alias("seqno"), F.col("o_totalprice").alias("value"), F.lit(False).alias("deleted"))


@_add("WITH e AS (SELECT max(o_orderkey) AS top FROM orders) SELECT o_orderkey AS key, o_orderkey + 1 AS seqno, o_totalprice AS value, false AS deleted FROM orders, e WHERE o_orderkey >= top // 10 AND o_orderkey < top * 4 // 10")
def snapshot_range(spark, d):
    """A snapshot is built, opened again and scanned."""
    top = _orders(spark, d).agg(F.max("key")).first()[0]

    def make(folder):
        snapshot.build(_orders(spark, d), f"{folder}/s", snapshot.Config("orders"))
        return snapshot.open_snapshot(spark, f"{folder}/s").index(spark).range(included(top // 10), excluded(top * 4 // 10))

    return _through(spark, "snapshot", make)


@_add(BASE + "SELECT * FROM v")
def snapshot_versions(spark, d):
    """A snapshot of all versions, validated."""

    def make(folder):
        s = snapshot.build(_versions(spark, d), f"{folder}/s", snapshot.Config("log", filter="fuse"))
        s.validate(spark)
        return s.table(spark)

    return _through(spark, "snapshot", make)


@_add(BASE + "SELECT (SELECT count(*) FROM t) AS n_count, (SELECT count(*) FROM t WHERE deleted) AS n_deleted, count(*) AS n_versions, max(seqno) AS seqno FROM v")
def snapshot_stats(spark, d):
    """Counts that are observed while a snapshot is written."""

    def make(folder):
        s = snapshot.build(_versions(spark, d), f"{folder}/s", snapshot.Config("log")).stats
        return spark.createDataFrame([tuple(s[k] for k in ("n_count", "n_deleted", "n_versions", "seqno"))], "n_count long, n_deleted long, n_versions long, seqno long")

    return _through(spark, "snapshot", make)


@_add(BASE + "SELECT t.* FROM t WHERE key IN (SELECT c_custkey * 3 FROM customer)")
def snapshot_filtered_get(spark, d):
    """Many keys looked up, those that the snapshot's filter excludes without a read."""

    def make(folder):
        s = snapshot.build(_versions(spark, d), f"{folder}/s", snapshot.Config("log", filter="xor8"))
        return s.get_all(spark, _t(spark, d, "customer").select((F.col("c_custkey") * 3).alias("key")))

    return _through(spark, "snapshot", make)


@_add(HALVES + ", x AS (SELECT * FROM a UNION ALL SELECT * FROM b), " + _tip("y", "x") + " SELECT * FROM y WHERE NOT deleted")
def snapshot_compacted(spark, d):
    """The older half built, the newer one merged over it, and both compacted."""

    def make(folder):
        newer, older = _parts(spark, d)
        first = snapshot.build(older, f"{folder}/0", snapshot.Config("log"))
        second = snapshot.incremental(spark, first, newer, f"{folder}/1")
        return snapshot.compact(spark, second, f"{folder}/2", MONO).table(spark)

    return _through(spark, "snapshot", make)


@_add(f"WITH {LOG}, " + ", ".join(_fold(f"q{k}", "m", f"seqno > {_at(k)} AND seqno <= {_at(k + 2)}") for k in range(0, 10, 2)) + ", u AS (" + " UNION ALL ".join(f"SELECT * FROM q{k}" for k in range(0, 10, 2)) + ") SELECT * FROM u")
def tree_versions(spark, d):
    """Fifths of the log written to a tree of levels, flushed and merged between."""

    def make(folder):
        tree = snapshot.Tree(spark, folder, snapshot.Config("log"))
        for k in range(0, 10, 2):
            tree.write(oplog.fold(_log(spark, d).where(within(F.col("seqno"), excluded(_share(spark, d, k)), included(_share(spark, d, k + 2))))))
            if k < 8:
                tree.flush()
                tree.compact()
        return tree.read().iter_versions()

    return _through(spark, "tree", make)


@_add(BASE + "SELECT min(key) AS first_key, max(key) AS last_key FROM t")
def first_last(spark, d):
    return oplog.fold_latest(_log(spark, d)).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@_add(BASE + "SELECT count(*) AS n_count, count(*) FILTER (deleted) AS n_deleted, (SELECT count(*) FROM v) AS n_versions, max(seqno) AS seqno, (SELECT CAST(sum(CASE WHEN deleted THEN 17 ELSE 25 END) AS BIGINT) FROM v) AS footprint FROM t")
def index_stats(spark, d):
    return I.stats(_versions(spark, d))


@_add(BASE + "SELECT count(*) AS n_count, count(*) FILTER (deleted) AS n_deleted FROM t")
def len_and_deleted(spark, d):
    return oplog.fold_latest(_log(spark, d)).agg(F.count("*").alias("n_count"), F.count_if("deleted").alias("n_deleted"))


@_add(f"WITH {LOG} SELECT max(seqno) AS seqno FROM m")
def max_seqno(spark, d):
    return _log(spark, d).agg(F.max("seqno").alias("seqno"))


@_add(BASE + "SELECT key, seqno, 'repeated seqno' AS problem FROM v WHERE seqno % 97 = 0 UNION ALL SELECT DISTINCT key, 0, 'seqno below 1' FROM v WHERE seqno % 89 = 0 UNION ALL SELECT key, 1000000000 + seqno, 'tombstone with a value' FROM v WHERE seqno % 83 = 0")
def validate(spark, d):
    """What is wrong with a table in which known rows are."""
    first = F.count(F.when(F.col("seqno") % 89 == 0, True)).over(Window.partitionBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1
    good = _versions(spark, d).withColumn("first", first & (F.col("seqno") % 89 == 0))
    row = lambda seqno, value, deleted: F.struct(seqno.alias("seqno"), value.alias("value"), deleted.alias("deleted"))
    seqno, same = F.col("seqno"), row(F.col("seqno"), F.col("value"), F.col("deleted"))
    below, tombstone = row(seqno * 0, F.lit(1.0), F.lit(False)), row(seqno + 1_000_000_000, F.lit(1.0), F.lit(True))
    # Planted beside the rows that they are made of, as each reading of the table is a fold of the whole log.
    rows = F.array(same, F.when(seqno % 97 == 0, same), F.when(F.col("first"), below), F.when(seqno % 83 == 0, tombstone))
    planted = good.select("key", F.explode(rows).alias("v")).where("v IS NOT NULL").select("key", "v.seqno", "v.value", "v.deleted")
    return I.violations(planted)


# -- operations --


@_add(f"""WITH {LOG} SELECT key, seqno, op, CASE WHEN o_op <> 'remove' THEN o_seqno END AS old_seqno,
      CASE WHEN o_op NOT IN ('remove', 'delete') THEN o_value END AS old_value, CASE WHEN o_op <> 'remove' THEN o_op = 'delete' END AS old_deleted
      FROM (SELECT *, lag(seqno) OVER w AS o_seqno, lag(value) OVER w AS o_value, lag(op) OVER w AS o_op FROM m WINDOW w AS (PARTITION BY key ORDER BY seqno))""")  # fmt: skip
def old_entry_lag(spark, d):
    return oplog.old_entries(_log(spark, d))


def _only(op: str) -> str:
    return f"WITH {LOG}, o AS (SELECT * FROM m WHERE op = '{op}'), {_fold('v', 'o')} SELECT * FROM v"


@_add(_only("set"))
def set_only(spark, d):
    return oplog.fold(_log(spark, d).where("op = 'set'"))


@_add(_only("insert"))
def insert_history(spark, d):
    return oplog.fold(_log(spark, d).where("op = 'insert'"))


@_add(_only("delete"))
def delete_tombstone(spark, d):
    return oplog.fold(_log(spark, d).where("op = 'delete'"))


@_add(f"WITH {LOG}, r AS (SELECT key, max(seqno) AS epoch FROM m WHERE op = 'remove' GROUP BY key) SELECT m.key, m.seqno, m.op FROM m LEFT JOIN r USING (key) WHERE m.op <> 'remove' AND m.seqno > coalesce(r.epoch, 0)")
def remove_epoch(spark, d):
    log = _log(spark, d)
    epoch = F.coalesce(F.max(F.when(F.col("op") == "remove", F.col("seqno"))).over(Window.partitionBy("key")), F.lit(0))
    return log.withColumn("epoch", epoch).where("op <> 'remove' AND seqno > epoch").select("key", "seqno", "op")


@_add(f"WITH {LOG} SELECT op, count(*) AS n FROM m GROUP BY op")
def op_counts(spark, d):
    return _log(spark, d).groupBy("op").agg(F.count("*").alias("n"))


@_add(HALVES + "SELECT * FROM b UNION ALL SELECT * FROM a")
def commit_batch_versions(spark, d):
    newer, older = _parts(spark, d)
    return oplog.commit(older, newer, True)


@_add(HALVES + """SELECT a.* FROM a WHERE key NOT IN (SELECT key FROM b)
      UNION ALL SELECT * FROM a_tip WHERE key IN (SELECT key FROM b)
      UNION ALL SELECT b.* FROM b LEFT JOIN a_tip x ON b.key = x.key WHERE x.key IS NULL OR x.deleted""")  # fmt: skip
def commit_batch_no_versions(spark, d):
    newer, older = _parts(spark, d)
    return oplog.commit(older, newer, False)


@_add(BASE + "SELECT v.* FROM v JOIN t USING (key) WHERE NOT t.deleted OR v.seqno = t.seqno")
def sticky_delete(spark, d):
    return oplog.sticky(_versions(spark, d))


@_add(f"WITH {LOG}, {_fold('v', 'm', 'seqno % 7 <> 0')} SELECT * FROM v")
def cas_fold(spark, d):
    """Each write expects the version that the last one of its key left; every seventh expects another one, and fails."""
    log = _log(spark, d)
    good = oplog.old_entries(log.where("seqno % 7 <> 0")).select("seqno", F.coalesce("old_seqno", F.lit(0)).alias("cas"))
    return oplog.cas_fold(log.drop("cas").join(good, "seqno", "left").withColumn("cas", F.coalesce("cas", F.lit(-1))))


@_add(f"""WITH {LOG}, p AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY key ORDER BY seqno), 'remove') AS before FROM m),
      n AS (SELECT key, op, value, row_number() OVER (ORDER BY seqno) AS seqno FROM p WHERE op <> 'remove' OR before <> 'remove'), {_fold('v', 'n')} SELECT * FROM v""")  # fmt: skip
def sequential_fold(spark, d):
    return oplog.sequential_fold(_log(spark, d), "seqno")


# -- version algebra --


@_add(BASE + "SELECT key, seqno, value, deleted FROM v")
def to_values(spark, d):
    return V.unpacked(V.packed(_versions(spark, d)))


@_add(BASE + "SELECT key, seqno, CAST(round(value * 1000000) AS BIGINT) AS value, deleted FROM v")
def non_identity_diff(spark, d):
    """Deltas as differences of newer and older values, folded back: whole millionths, so that no digit is lost."""
    whole = _versions(spark, d).withColumn("value", F.round(F.col("value") * 1_000_000).cast("long"))
    return V.unpacked(V.encoded(whole, lambda newer, older: newer - older), lambda newer, delta: newer - delta)


@_add(BASE + "SELECT key, min(seqno) AS oldest_seqno FROM v GROUP BY key")
def oldest_seqno(spark, d):
    return V.summary(_versions(spark, d)).select("key", "oldest_seqno")


@_add(BASE + "SELECT key, count(*) - 1 AS deltas FROM v GROUP BY key")
def delta_count(spark, d):
    return V.summary(_versions(spark, d)).select("key", "deltas")


@_add(HALVES + f", {_fold('w', 'm')} SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.key = w.key AND b.seqno = w.seqno AND b.value IS NOT DISTINCT FROM w.value AND b.deleted = w.deleted)")
def contains_versions(spark, d):
    """Versions of the whole log that the older half lacks."""
    return V.lacking(_parts(spark, d)[1], _versions(spark, d))


@_add(f"WITH {LOG}, e AS (SELECT * FROM m WHERE seqno % 2 = 0), o AS (SELECT * FROM m WHERE seqno % 2 = 1), {_fold('x', 'e')}, {_fold('y', 'o')} SELECT * FROM x UNION ALL SELECT * FROM y")
def entry_commit_interleave(spark, d):
    log = _log(spark, d)
    return V.interleave(oplog.fold(log.where("seqno % 2 = 0")), oplog.fold(log.where("seqno % 2 = 1")))


@_add(BASE + "SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC) - 1 AS age FROM v")
def versions_newest_first(spark, d):
    return V.newest_first(_versions(spark, d)).withColumn("age", F.col("age").cast("long"))


# -- compaction --

CUT = _at(6)


def _compact(name: str, kind: str, bound: Callable[[int], Bound] | None, keep: str) -> None:
    def query(spark, d):
        return V.compact(_versions(spark, d), Cutoff(kind, UNBOUNDED if bound is None else bound(_share(spark, d, 6))))

    query.__name__ = name
    _add(BASE + f"SELECT v.* FROM v JOIN t USING (key) WHERE {keep}")(query)


for _name, _kind, _bound, _keep in (
    ("compact_mono", "mono", None, "v.seqno = t.seqno AND NOT t.deleted"),
    ("compact_lsm_incl", "lsm", included, f"v.seqno > {CUT}"),
    ("compact_lsm_excl", "lsm", excluded, f"v.seqno >= {CUT}"),
    ("compact_lsm_unbounded", "lsm", None, "false"),
    ("compact_tombstone_incl", "tombstone", included, f"NOT (t.deleted AND t.seqno <= {CUT})"),
    ("compact_tombstone_excl", "tombstone", excluded, f"NOT (t.deleted AND t.seqno < {CUT})"),
    ("compact_tombstone_unbounded", "tombstone", None, "NOT t.deleted"),
    ("compact_noop", "lsm", lambda _: excluded(0), "true"),
):
    _compact(_name, _kind, _bound, _keep)

# -- merges --


@_add(HALVES + "SELECT * FROM a UNION ALL SELECT * FROM b_tip")
def lsm_merge_latest(spark, d):
    return V.merge(*_parts(spark, d), versions=False)


@_add(HALVES + "SELECT * FROM a UNION ALL SELECT * FROM b")
def lsm_merge_versions(spark, d):
    return V.merge(*_parts(spark, d), versions=True)


@_add(HALVES + "SELECT * FROM a_tip UNION ALL SELECT * FROM b_tip WHERE key NOT IN (SELECT key FROM a_tip)")
def y_get_first_level(spark, d):
    return V.first_level(_parts(spark, d))


THIRDS = f"WITH {LOG}, {_fold('p', 'm', 'seqno % 3 = 0')}, {_fold('q', 'm', 'seqno % 3 = 1')}, {_fold('r', 'm', 'seqno % 3 = 2')}, u AS (SELECT * FROM p UNION ALL SELECT * FROM q UNION ALL SELECT * FROM r), {_tip('t', 'u')} "


def _thirds(spark, d) -> list[DataFrame]:
    return [oplog.fold(_log(spark, d).where(f"seqno % 3 = {k}")) for k in range(3)]


@_add(THIRDS + "SELECT * FROM t")
def level_winner_nway(spark, d):
    return V.level_winner(_thirds(spark, d))


@_add(THIRDS + "SELECT * FROM u")
def levels_versions_nway(spark, d):
    return V.scan_within(_thirds(spark, d))


@_add(HALVES + "SELECT a.* FROM a UNION ALL SELECT b.* FROM b")
def append_disjoint(spark, d):
    return V.append(*_parts(spark, d))


# -- seqno windows and shards --


@_add(BASE + ", w AS (SELECT * FROM v WHERE seqno <= " + _at(8) + "), " + _tip("x", "w") + " SELECT * FROM x")
def asof_seqno(spark, d):
    return V.as_of(_versions(spark, d), _share(spark, d, 8))


@_add(BASE + f"SELECT * FROM v WHERE seqno > {_at(3)} AND seqno <= {_at(8)}")
def seqno_window(spark, d):
    return V.seqno_window(_versions(spark, d), excluded(_share(spark, d, 3)), included(_share(spark, d, 8)))


@_add("SELECT o_orderkey AS key, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS shard FROM orders")
def shard_ntile(spark, d):
    return shards.as_shards(_t(spark, d, "orders").select(F.col("o_orderkey").alias("key")), 7)


@_add("SELECT o_orderkey AS key, CASE WHEN o_orderkey < 1000 THEN 0 WHEN o_orderkey < 3000 THEN 1 ELSE 2 END AS part FROM orders")
def part_by_ranges(spark, d):
    ranges = shards.high_keys_to_ranges([excluded(1000), excluded(3000), UNBOUNDED])
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return rows.select("key", shards.by_ranges(F.col("key"), ranges).alias("part")).where("part IS NOT NULL")


@_add("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 100")
def piecewise_page(spark, d):
    return V.page(_t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value")), 700, 100)


@_add(BASE + "SELECT key < 75 AS low, count(*) AS n FROM t GROUP BY 1")
def split_by_pivot(spark, d):
    low, high = shards.split(oplog.fold_latest(_log(spark, d)), 75)
    return low.select(F.lit(True).alias("low")).union(high.select(F.lit(False))).groupBy("low").agg(F.count("*").alias("n"))


# -- membership --


@_add("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def bitmap_cardinality(spark, d):
    return membership.cardinality(membership.bitmaps(_t(spark, d, "orders").select(F.col("o_custkey").alias("digest"))))


@_add("SELECT count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT user_id FROM events)")
def bitmap_union_cardinality(spark, d):
    one = membership.bitmaps(_t(spark, d, "orders").select(F.col("o_custkey").alias("digest")))
    return membership.cardinality(membership.union(one, membership.bitmaps(_t(spark, d, "events").select(F.col("user_id").alias("digest")))))


@_add("SELECT c_custkey AS digest, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer")
def bitmap_contains(spark, d):
    sets = membership.bitmaps(_t(spark, d, "orders").select(F.col("o_custkey").alias("digest")))
    return membership.contains(_t(spark, d, "customer").select(F.col("c_custkey").alias("digest")), sets)


@_add("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def membership_semi(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@_add("SELECT count(*) AS n, true AS found FROM customer")
def membership_none(spark, d):
    return membership.accept_all(_t(spark, d, "customer")).groupBy("found").agg(F.count("*").alias("n"))


# -- log --


def _records(spark, d) -> DataFrame:
    return _t(spark, d, "events").select((F.col("event_id") + 1).alias("seqno"), F.col("event_type").cast("binary").alias("op"))


@_add(f"SELECT event_id + 1 AS seqno, event_type AS op FROM events WHERE event_id + 1 > {_at(1)} AND event_id + 1 <= {_at(9)}")
def wal_range(spark, d):
    return wal.in_range(_records(spark, d), excluded(_share(spark, d, 1)), included(_share(spark, d, 9))).withColumn("op", F.col("op").cast("string"))


@_add(f"SELECT event_id + 1 AS seqno, event_type AS op FROM events WHERE event_id + 1 > {_at(3)}")
def wal_journals(spark, d):
    """The log appended in three parts to journals that rotate, loaded again, its oldest part purged, and read from a seqno on."""

    def make(folder):
        config = wal.Config(folder, "events", journal_limit=1)
        log = wal.Wal.create(spark, config)
        mid = _share(spark, d, 3)
        for low, high in ((-1, mid), (mid, _share(spark, d, 6)), (_share(spark, d, 6), 2**62)):
            log.append(spark, _t(spark, d, "events").where(within(F.col("event_id") + 1, excluded(low), included(high))), "event_id", "event_type")
        again = wal.Wal.load(spark, config)
        again.purge_till(spark, mid)
        return again.replay_from(spark, mid).withColumn("op", F.col("op").cast("string"))

    return _through(spark, "log", make)


@_add(f"WITH {LOG}, {_fold('v', 'm')} SELECT * FROM v")
def wal_replayed_index(spark, d):
    """Half of the log in an index, the rest replayed onto it from journals."""

    def make(folder):
        log = wal.Wal.create(spark, folder, "events")
        packed = _log(spark, d).select("seqno", F.to_json(F.struct("op", "key", "value")).cast("binary").alias("op"))
        log.write(spark, packed)
        mid = _share(spark, d, 5)
        index = I.Index("log", oplog.fold(_log(spark, d).where(F.col("seqno") <= mid)), seqno=mid)

        def mutations(records):
            row = F.from_json(F.col("op").cast("string"), "op string, key long, value double").alias("row")
            return records.select("seqno", row).select("seqno", "row.*", F.lit(None).cast("long").alias("cas"))

        return log.replay(spark, index, mutations).versions

    return _through(spark, "log", make)


@_add("SELECT event_id // 64 AS batch, min(event_id + 1) AS first_seqno, max(event_id + 1) AS last_seqno, count(*) AS n FROM events GROUP BY 1")
def wal_batches(spark, d):
    return wal.batches(_records(spark, d), 64)


@_add(f"WITH {LOG}, {_fold('v', 'm', f'seqno > {_at(5)}')} SELECT * FROM v")
def wal_replay_from(spark, d):
    return oplog.fold(_log(spark, d).where(F.col("seqno") > _share(spark, d, 5)))


@_add("SELECT CAST(user_id % 5 AS INTEGER) AS shard, count(*) AS n FROM events GROUP BY 1")
def wal_shards(spark, d):
    return shards.hashed(_log(spark, d), 5).groupBy("shard").agg(F.count("*").alias("n"))


@_add("SELECT count(*) AS n, CAST(sum(event_id + 1) AS BIGINT) AS total FROM events")
def wal_seqno_sum(spark, d):
    return _records(spark, d).agg(F.count("*").alias("n"), F.sum("seqno").alias("total"))


# -- dataflow --


@_add("SELECT event_id, value * 2 AS doubled FROM events")
def mq_map(spark, d):
    return stages.map_(_t(spark, d, "events"), event_id=F.col("event_id"), doubled=F.col("value") * 2)


@_add("SELECT event_id, value FROM events WHERE value > 50")
def mq_filter(spark, d):
    return stages.filter_(_t(spark, d, "events").select("event_id", "value"), F.col("value") > 50)


@_add("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def mq_filter_map(spark, d):
    return stages.filter_map(_t(spark, d, "events"), "k", F.get_json_object("props", "$.k").cast("long"))


@_add("SELECT count(*) AS n, max(value) AS top, CAST(sum(user_id) AS BIGINT) AS total FROM events")
def mq_reduce(spark, d):
    return stages.reduce_(_t(spark, d, "events"), n=F.count("*"), top=F.max("value"), total=F.sum("user_id"))


@_add("SELECT branch, event_id FROM events, (VALUES (0), (1), (2)) b(branch) WHERE value > 50")
def mq_split(spark, d):
    """A stream of the events, filtered, to three sinks."""

    def make(folder):
        stream = stages.from_files(spark, f"{d}/events.parquet*", _t(spark, d, "events").schema)
        sink = lambda k: lambda rows, _: rows.select(F.lit(k).alias("branch"), "event_id").write.mode("append").parquet(f"{folder}/out")
        stages.close_wait(stages.split(stages.filter_(stream, F.col("value") > 50), [sink(k) for k in range(3)], f"{folder}/checkpoint"))
        return spark.read.schema("branch int, event_id long").parquet(f"{folder}/out")

    return _through(spark, "stream", make)


@_add("SELECT count(*) AS n, max(value) AS top FROM events")
def mq_fold(spark, d):
    """A stream of the events, reduced with an identity and functions."""

    def make(folder):
        stream = stages.from_files(spark, f"{d}/events.parquet*", _t(spark, d, "events").schema).select("value")
        out = []
        top = lambda *x: max((v for v in x if v is not None), default=None)
        stages.close_wait(stages.fold(stream, (0, None), lambda s, r: (s[0] + 1, top(s[1], r["value"])), lambda a, b: (a[0] + b[0], top(a[1], b[1])), out.append, f"{folder}/checkpoint"))
        return spark.createDataFrame(out, "n long, top double")

    return _through(spark, "stream", make)


# -- objects and paths --


@_add("SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS oid FROM documents WHERE text IS NOT NULL")
def git_blob_oid(spark, d):
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.blob_oid(F.col("text")).alias("oid"))


@_add("SELECT lang || '/' || doc_id AS key, sha1('blob ' || strlen(text) || chr(0) || text) AS oid FROM documents WHERE text IS NOT NULL AND lang >= 'de' AND lang < 'fr'")
def store_scan(spark, d):
    """A range of paths of a store of blobs."""
    rows = _t(spark, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    store = objects.Store.of(rows, F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")), F.col("text"))
    return store.scan(included(["de"]), excluded(["fr"])).select(F.array_join("path", "/").alias("key"), "oid")


@_add("""SELECT p_partkey, array_to_string(list_concat(list_transform(range(1, least(3, length(p_name)) + 1), lambda i: p_name[i]), [p_name]), '|') AS path FROM part""")
def key_path_fanout(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.array_join(X.key_path(F.col("p_name")), "|").alias("path"))


@_add("SELECT page_id, url FROM (SELECT *, replace(url, '/', chr(1)) AS p FROM pages) WHERE p >= replace('https://', '/', chr(1)) AND p < replace('https://site5', '/', chr(1))")
def path_range(spark, d):
    parts = X.path(F.col("url"))
    low, high = (F.array(*map(F.lit, x.split("/"))) for x in ("https://", "https://site5"))
    return _t(spark, d, "pages").where((parts >= low) & (parts < high)).orderBy(parts).select("page_id", "url")


@_add("""WITH f AS (SELECT DISTINCT string_split(url, '/')[1:3] AS p FROM pages WHERE page_id % 10 = 0)
      SELECT page_id, url FROM pages WHERE string_split(url, '/')[1:3] NOT IN (SELECT p FROM f)""")  # fmt: skip
def path_excluded(spark, d):
    rows = _t(spark, d, "pages").withColumn("path", X.path(F.col("url")))
    folders = rows.where("page_id % 10 = 0").select(F.slice("path", 1, 3).alias("path"))
    return objects.excluded(rows, folders).select("page_id", "url")


@_add("""WITH p AS (SELECT DISTINCT string_split(url, '/') AS p FROM pages), n AS (SELECT DISTINCT p[1:i] AS path FROM p, range(1, 40) r(i) WHERE i <= len(p))
      SELECT array_to_string(path, '|') AS path, CAST(len(path) AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY path[1:len(path) - 1] ORDER BY path) - 1 AS INTEGER) AS breadth FROM n""")  # fmt: skip
def trie_walk_depth(spark, d):
    rows = _t(spark, d, "pages").select(X.path(F.col("url")).alias("path"), F.col("page_id").alias("value")).groupBy("path").agg(F.max("value").alias("value"))
    return objects.trie_walk(rows).select(F.array_join("path", "|").alias("path"), "depth", "breadth")


@_add("SELECT upper(left(lang, 1)) AS namespace, count(*) AS n FROM documents GROUP BY 1")
def count_by_namespace(spark, d):
    return zim.by_namespace(_t(spark, d, "documents").select(F.upper(F.substring("lang", 1, 1)).alias("namespace")))


@_add("SELECT CAST(page_id AS INTEGER) AS id, CAST(page_id - page_id % 5 AS INTEGER) AS target FROM pages")
def redirect_resolve(spark, d):
    """Each page whose id isn't a multiple of five redirects to the one before it."""
    page = F.col("page_id").cast("int")
    rows = _t(spark, d, "pages").select(page.alias("id"), F.when(page % 5 != 0, page - 1).alias("redirect"))
    return zim.resolved(rows)


# -- statistics --


@_add("""WITH h AS (SELECT least(CAST(floor(value / 5) AS BIGINT), 99) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1),
      c AS (SELECT bucket, CAST(floor(sum(n) OVER (ORDER BY bucket) * 100 / sum(n) OVER ()) AS BIGINT) AS percentile FROM h)
      SELECT percentile, bucket FROM (SELECT *, greatest(coalesce(lag(percentile) OVER (ORDER BY bucket), 0), 90) AS before FROM c) WHERE percentile > before""")  # fmt: skip
def hist_percentiles(spark, d):
    return stats.percentiles(stats.histogram(_t(spark, d, "events"), "value", 5, 100))


@_add("SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) WHERE k = CAST(floor(n * 0.99) AS BIGINT)")
def p99_nearest_rank(spark, d):
    return stats.nearest_rank(_t(spark, d, "events"), "value")


@_add("SELECT date_trunc('second', ts) AS second, CAST(sum(user_id) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def throughput_1s(spark, d):
    out = stats.throughput(_t(spark, d, "events"), "ts", "user_id")
    return out.withColumn("second", F.col("second").cast("timestamp_ntz"))


@_add("SELECT count(user_id) AS n, min(user_id) AS min, max(user_id) AS max, CAST(floor(sum(user_id) / count(user_id)) AS BIGINT) AS mean FROM events")
def depth_summary(spark, d):
    return stats.summary(_t(spark, d, "events"), "user_id")


@_add("""SELECT o_orderkey, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') < 90 THEN 'hot'
      WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') < 360 THEN 'cold' ELSE 'frozen' END AS age FROM orders""")  # fmt: skip
def age_bucket(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", X.age_bucket(F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")).alias("age"))


@_add("""SELECT doc_id, CASE WHEN n_chars * 100 >= 1099511627776 THEN (n_chars * 100) // 1099511627776 || 'tb' WHEN n_chars * 100 >= 1073741824 THEN (n_chars * 100) // 1073741824 || 'gb'
      WHEN n_chars * 100 >= 1048576 THEN (n_chars * 100) // 1048576 || 'mb' WHEN n_chars * 100 >= 1024 THEN (n_chars * 100) // 1024 || 'kb' ELSE (n_chars * 100) || 'b' END AS size FROM documents""")  # fmt: skip
def humanize_bytes(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.humanize(F.col("n_chars") * 100).alias("size"))


@_add("SELECT key, used, seq FROM (SELECT user_id AS key, ts AS used, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 ORDER BY used DESC, seq DESC LIMIT 20")
def lru_keep_n(spark, d):
    return shards.keep_recent(_t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("used"), F.col("event_id").alias("seq")), 20, at="used")


# -- HTML --


@_add()
def html_nodes(spark, d):
    nodes = H.html_nodes(_t(spark, d, "pages"))
    return nodes.select("page_id", "node_id", "parent_id", "depth", "kind", "tag", "text")


@_add()
def html_text_lines(spark, d):
    return H.html_text_lines(_t(spark, d, "pages"))


@_add()
def html_select(spark, d):
    return H.html_select(_t(spark, d, "pages"), "body p, a[href]").select("page_id", "node_id", "tag", "text")


@_add("""SELECT page_id, regexp_extract(x, 'href="([^"]*)"', 1) AS href, regexp_extract(x, '>([^<>]*)</a>', 1) AS text
      FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li><a href="[^"]*">[^<>]*</a></li>')) AS x FROM pages)""")  # fmt: skip
def html_links(spark, d):
    return H.html_select(_t(spark, d, "pages"), "nav > ul > li > a[href]").select("page_id", F.col("attrs")["href"].alias("href"), "text")


@_add("""SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(regexp_replace(html, '<!--.*?-->', '', 'gs')), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag""")
def html_tag_counts(spark, d):
    return H.html_nodes(_t(spark, d, "pages")).where("kind = 'tag'").groupBy("tag").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
