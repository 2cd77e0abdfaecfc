"""Named queries over the engine's operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.crc32c import segment_checksums
from .operators import aggregate, compaction, mvcc, predicate, stats
from .plans import derived as d
from .plans import recovery
from .schema import ROW_ID, PredicateOp, Reader
from .sources import segments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


# Aggregates

_FILTER_SUM = "SELECT CAST(coalesce(sum(l_partkey), 0) AS BIGINT) AS sum, count(*) AS matched_count FROM lineitem WHERE l_orderkey > {}"


@query("SELECT CAST(coalesce(sum(l_partkey), 0) AS BIGINT) AS sum FROM lineitem")
def scan_sum(spark, sf):
    return aggregate.scan_sum(d.table(spark, sf, "lineitem"), "l_partkey")


@query("SELECT 5 * CAST(coalesce(sum(l_partkey), 0) AS BIGINT) AS sum FROM lineitem")
def scan_sum_wrap(spark, sf):
    """The wrapping sum equals the exact one while that fits."""
    return aggregate.scan_sum(d.table(spark, sf, "lineitem").select((F.col("l_partkey") * 5).alias("x")), "x", overflow="wrap")


@query(_FILTER_SUM.format(7500))
def filter_gt_sum(spark, sf):
    return aggregate.filter_gt_sum(d.table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", 7500)


@query(_FILTER_SUM.format(10**15))
def filter_gt_sum_empty(spark, sf):
    return aggregate.filter_gt_sum(d.table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", 10**15)


@query(_FILTER_SUM.format(7500))
def filter_gt_sum_volcano(spark, sf):
    return aggregate.filter_gt_sum(d.table(aggregate.strategy_session(spark, "row"), sf, "lineitem"), "l_orderkey", "l_partkey", 7500)


@query(_FILTER_SUM.format(7500))
def filter_gt_sum_vectorized(spark, sf):
    return aggregate.filter_gt_sum(d.table(aggregate.strategy_session(spark, "arrow"), sf, "lineitem"), "l_orderkey", "l_partkey", 7500, arrow=True)


@query(_FILTER_SUM.format(7500))
def filter_gt_sum_codegen(spark, sf):
    return aggregate.filter_gt_sum(d.table(aggregate.strategy_session(spark, "codegen"), sf, "lineitem"), "l_orderkey", "l_partkey", 7500)


@query("SELECT l_orderkey // 1000 AS segment_id, CAST(sum(l_partkey) AS BIGINT) AS partial_sum, count(*) AS partial_count FROM lineitem WHERE l_partkey > 100 GROUP BY 1")
def partial_final_sum(spark, sf):
    df = d.table(spark, sf, "lineitem").where(F.col("l_partkey") > 100)
    return df.groupBy(F.expr("l_orderkey div 1000").alias("segment_id")).agg(F.sum("l_partkey").alias("partial_sum"), F.count(F.lit(1)).alias("partial_count"))


@query("SELECT CAST(coalesce(sum(CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE l_partkey END), 0) AS BIGINT) AS sum, count(*) AS matched_count FROM lineitem WHERE coalesce(nullif(l_orderkey % 10, 0), 0) > -1")
def null_as_zero_sum(spark, sf):
    df = d.table(spark, sf, "lineitem").select(F.expr("nullif(l_orderkey % 10, 0)").alias("p"), F.expr("CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey END").alias("a"))
    return aggregate.filter_gt_sum(df, "p", "a", -1, nulls="zero")


@query("SELECT CAST(coalesce(sum(l_partkey), 0) AS BIGINT) AS sum, count(*) AS matched_count FROM lineitem WHERE nullif(l_orderkey % 10, 0) > -1")
def pred_null_excluded(spark, sf):
    df = d.table(spark, sf, "lineitem").select(F.expr("nullif(l_orderkey % 10, 0)").alias("p"), "l_partkey")
    return aggregate.filter_gt_sum(df, "p", "l_partkey", -1)


# Predicates and projection

_COLUMNS = {"int32": ("l_linenumber", 3, "3"), "int64": ("l_orderkey", 7500, "7500"), "double": ("l_quantity", 25.0, "25.0"), "string": ("l_returnflag", "N", "'N'")}


def _predicate(op: PredicateOp, column: str, value, sql: str) -> Query:
    def run(spark, sf):
        return predicate.where_op(d.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), column, op, value)

    return run


for _op in PredicateOp:
    for _kind, (_c, _v, _s) in _COLUMNS.items():
        query(f"SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE {_c} {_op.value} {_s}", f"pred_{_op.name.lower()}_{_kind}")(_predicate(_op, _c, _v, _s))


@query("SELECT l_orderkey, l_partkey, CASE WHEN l_orderkey < l_partkey THEN -1 WHEN l_orderkey > l_partkey THEN 1 ELSE 0 END AS cmp FROM lineitem")
def compare_three_way(spark, sf):
    return d.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", predicate.three_way(F.col("l_orderkey"), F.col("l_partkey")).alias("cmp"))


@query("SELECT o_custkey, o_orderkey FROM orders")
def project_columns(spark, sf):
    return d.table(spark, sf, "orders").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey AS cust, o_orderstatus AS status FROM orders")
def strip_row_id(spark, sf):
    return d.base(spark, sf).drop(ROW_ID)


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_orderkey = 77")
def row_id_exists(spark, sf):
    return d.base(spark, sf).where(F.col(ROW_ID) == 77).agg((F.count(F.lit(1)) > 0).alias("found"))


# Segments

_SEGMENT_STATS = """SELECT o_orderkey // 1000 AS segment_id, count(*) AS row_count, min(nullif(o_custkey % 7, 0)) AS c_min, max(nullif(o_custkey % 7, 0)) AS c_max,
count(*) - count(nullif(o_custkey % 7, 0)) AS c_nulls, min(o_orderkey) AS o_orderkey_min, max(o_orderkey) AS o_orderkey_max, 0 AS o_orderkey_nulls FROM orders GROUP BY 1"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.expr("nullif(o_custkey % 7, 0)").alias("c"), "o_orderstatus", F.expr("o_orderkey div 1000").alias("segment_id"))


@query(_SEGMENT_STATS)
def segment_stats(spark, sf):
    return stats.segment_stats(_segments(spark, sf), "segment_id", ["c", "o_orderkey"])


def _skips() -> str:
    rule = {"EQ": "5500 < lo OR 5500 > hi", "NE": "false", "LT": "5500 <= lo", "LE": "5500 < lo", "GT": "5500 >= hi", "GE": "5500 > hi"}
    inner = "SELECT o_orderkey // 1000 AS segment_id, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1"
    return " UNION ALL ".join(f"SELECT segment_id, '{k}' AS op, ({v}) AS skipped FROM ({inner})" for k, v in rule.items())


@query(_skips())
def segment_can_skip(spark, sf):
    st = stats.segment_stats(_segments(spark, sf), "segment_id", ["o_orderkey"])
    out = None
    for op in PredicateOp:
        one = stats.skip_report(st, "o_orderkey", T.LongType(), op, 5500).select("segment_id", F.lit(op.name).alias("op"), "skipped")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS sum, count(*) AS matched_count FROM orders WHERE o_orderkey > 9500")
def pruned_sum(spark, sf):
    df = _segments(spark, sf)
    live = stats.pruned_where(df, stats.segment_stats(df, "segment_id", ["o_orderkey"]), "segment_id", "o_orderkey", PredicateOp.GT, 9500)
    return aggregate.filter_gt_sum(live, "o_orderkey", "o_custkey", 9500)


@query("SELECT count(nullif(o_custkey % 7, 0)) AS c_valid, count(*) - count(nullif(o_custkey % 7, 0)) AS c_nulls, count(*) = count(nullif(o_custkey % 7, 0)) AS c_all_valid, count(*) AS o_orderkey_valid, 0 AS o_orderkey_nulls, true AS o_orderkey_all_valid FROM orders")
def validity_counts(spark, sf):
    return stats.validity_counts(_segments(spark, sf), ["c", "o_orderkey"])


_DICTIONARY = "dict AS (SELECT v, row_number() OVER (ORDER BY p) - 1 AS code FROM (SELECT o_orderpriority AS v, min(o_orderkey) AS p FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1))"


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.dictionary(d.table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


@query(f"WITH {_DICTIONARY} SELECT o_orderkey, code FROM orders LEFT JOIN dict ON v = o_orderpriority")
def dictionary_encode(spark, sf):
    return stats.encode(d.table(spark, sf, "orders"), _dictionary(spark, sf), "o_orderpriority").select("o_orderkey", "code")


@query("SELECT o_orderkey, o_orderpriority AS o_orderpriority_decoded FROM orders")
def dictionary_decode(spark, sf):
    words = _dictionary(spark, sf)
    coded = stats.encode(d.table(spark, sf, "orders"), words, "o_orderpriority").select("o_orderkey", "code")
    return stats.decode(coded, words, "o_orderpriority").select("o_orderkey", "o_orderpriority_decoded")


@query("SELECT count(DISTINCT o_orderpriority) AS size FROM orders")
def dictionary_size(spark, sf):
    return d.table(spark, sf, "orders").agg(F.count_distinct("o_orderpriority").alias("size"))


@query("SELECT count(*) AS base_rows, count(DISTINCT o_orderkey // 1000) AS segments FROM orders")
def row_counts(spark, sf):
    return _segments(spark, sf).agg(F.count(F.lit(1)).alias("base_rows"), F.count_distinct("segment_id").alias("segments"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS __row_id__ FROM orders")
def assign_row_ids(spark, sf):
    return stats.assign_row_ids(d.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query()
def segment_checksum_crc32c(spark, sf):
    return segment_checksums(_segments(spark, sf), "segment_id", "o_orderstatus")


@query("SELECT o_orderkey // 1000 AS segment_id, bool_or(o_orderkey % 2500 = 7) AS damaged FROM orders GROUP BY 1")
def segment_verify(spark, sf):
    """Checksums taken before some cells are changed tell the segments that hold them."""
    df = _segments(spark, sf)
    changed = df.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2500 == 7, "?").otherwise(F.col("o_orderstatus")))
    return segments.verify(changed, segment_checksums(df, "segment_id", "o_orderstatus"), "segment_id", "o_orderstatus")


@query("SELECT v AS word, CAST(code AS BIGINT) AS code FROM (VALUES ('N', 0), ('A', 1), ('', 2), ('R', 3)) t(v, code)")
def dictionary_rebuild(spark, sf):
    return stats.rebuild_dictionary(spark, ["N", "A", "", "R"], "word")


# Snapshots

_READERS = {"snapshot_read": (8, 1050), "snapshot_own_writes": (14, 1050), "snapshot_old_reader": (9999, 1003), "snapshot_after_abort": (15, 1097)}


def _snapshot(me: int, ts: int) -> Query:
    return lambda spark, sf: mvcc.snapshot_read(d.base(spark, sf), d.delta(spark, sf), d.txn(spark, sf), Reader(me, ts))


for _name, _r in _READERS.items():
    query(d.snapshot_sql(*_r), _name)(_snapshot(*_r))


@query(f"SELECT CAST(coalesce(sum(cust), 0) AS BIGINT) AS sum, count(*) AS matched_count FROM ({d.snapshot_sql(8, 1050)}) WHERE __row_id__ > 5000")
def snapshot_filter_sum(spark, sf):
    return aggregate.filter_gt_sum(_snapshot(8, 1050)(spark, sf), ROW_ID, "cust", 5000)


@query(f"""WITH {d.DELTA_SQL}, w AS (SELECT o_orderkey AS row_id FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey + 1000000000 FROM orders WHERE o_orderkey % 20 < 10),
k AS (SELECT row_id, seq, CASE WHEN deleted_txn = 8 OR (deleted_txn <> 0 AND xs = 'COMMITTED') THEN 'SKIP' WHEN deleted_txn <> 0 AND xs = 'ACTIVE' THEN 'CONFLICT'
  WHEN created_txn IN (0, 8) OR (cs = 'COMMITTED' AND cts <= 1050) THEN 'OK' ELSE 'SKIP' END AS k FROM ds),
a AS (SELECT row_id, count(*) AS n, arg_max(k, seq) FILTER (WHERE k <> 'SKIP') AS k, max(seq) FILTER (WHERE k <> 'SKIP') AS seq FROM k GROUP BY row_id)
SELECT w.row_id, CASE WHEN a.k IS NOT NULL THEN a.k WHEN a.n IS NULL AND w.row_id IN (SELECT o_orderkey FROM orders) THEN 'OK' ELSE 'NOT_FOUND' END AS outcome, a.seq FROM w LEFT JOIN a ON a.row_id = w.row_id""")
def claim_outcomes(spark, sf):
    k = F.col("o_orderkey")
    o = d.table(spark, sf, "orders")
    writes = o.where(k % 3 == 0).select(k.alias("row_id")).union(o.where(k % 20 < 10).select((k + 1000000000).alias("row_id")))
    return mvcc.claim_outcomes(writes, d.delta(spark, sf), d.txn(spark, sf), d.base(spark, sf), Reader(8, 1050))


@query(f"WITH {d.TXN_SQL} SELECT coalesce(min(snapshot_ts) FILTER (WHERE state = 'ACTIVE'), max(commit_ts) FILTER (WHERE state = 'COMMITTED'), 0) AS watermark FROM st")
def oldest_active_snapshot(spark, sf):
    return mvcc.oldest_active_snapshot(d.txn(spark, sf))


@query(f"WITH {d.TXN_SQL} SELECT count(*) FILTER (WHERE state = 'ACTIVE') AS active FROM st")
def active_txn_count(spark, sf):
    return mvcc.active_txn_count(d.txn(spark, sf))


# Compaction

_W = 1060


def _compacted(spark: SparkSession, sf: str) -> compaction.Compacted:
    return compaction.compact(d.base(spark, sf), d.delta(spark, sf), d.txn(spark, sf), _W)


@query(f"{d.class_sql(_W)} SELECT o_orderkey AS __row_id__, o_custkey AS cust, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT row_id FROM cl WHERE class = 'PURGE') UNION ALL SELECT row_id, cust, status FROM cl WHERE class = 'PROMOTED'")
def compact_base(spark, sf):
    return _compacted(spark, sf).base


@query(f"{d.class_sql(_W)} SELECT seq, row_id, created_txn, deleted_txn, tomb AS is_base_tombstone, cust, status FROM cl WHERE class = 'RETAINED'")
def compact_delta(spark, sf):
    return _compacted(spark, sf).delta.select("seq", "row_id", "created_txn", "deleted_txn", "is_base_tombstone", "row.*")


@query(f"{d.class_sql(_W)} SELECT count(*) FILTER (WHERE class = 'PROMOTED') AS rows_promoted, count(*) FILTER (WHERE class IN ('RETIRED', 'DROPPED', 'PURGE')) AS rows_retired, count(*) FILTER (WHERE class = 'RETAINED') AS rows_retained FROM cl")
def compact_metrics(spark, sf):
    return _compacted(spark, sf).metrics()


# Log and recovery

_BAD, _CHECKPOINT = 30001, 20003


@query(f"{d.log_sql(_BAD)} SELECT lsn, txn_id, type, row_id, cust, status FROM log")
def wal_valid_prefix(spark, sf):
    return recovery.valid_prefix(d.log(spark, sf, _BAD)).select("lsn", "txn_id", "type", "row_id", "row.*")


@query(f"{d.log_sql(_BAD)} SELECT count(*) AS records_read, coalesce(max(lsn), 0) AS last_valid_lsn, (SELECT count(*) > 0 FROM full_log WHERE lsn = {_BAD}) AS corrupt_record FROM log")
def wal_stats(spark, sf):
    return recovery.log_stats(d.log(spark, sf, _BAD))


_HOLES = "WITH l AS (SELECT o_orderkey AS lsn FROM orders WHERE o_orderkey % 1301 <> 1300), n AS (SELECT lsn, (SELECT min(o_orderkey) FROM orders) + row_number() OVER (ORDER BY lsn) - 1 AS want FROM l)"


def _dense_log(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """A log with an LSN for each order, of which some are missing, and its first LSN."""
    o = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("lsn"))
    return o.where(F.col("lsn") % 1301 != 1300).withColumn("bad", F.lit(False)), o.agg(F.min("lsn")).first()[0]


@query(f"{_HOLES} SELECT lsn FROM n WHERE lsn = want")
def wal_hole_prefix(spark, sf):
    return recovery.valid_prefix(*_dense_log(spark, sf))


@query(f"{_HOLES} SELECT count(*) FILTER (WHERE lsn = want) AS records_read, max(lsn) FILTER (WHERE lsn = want) AS last_valid_lsn, false AS corrupt_record, bool_or(lsn <> want) AS truncated_tail FROM n")
def wal_hole_stats(spark, sf):
    return recovery.log_stats(*_dense_log(spark, sf))


@query(f"{d.log_sql()} SELECT txn_id FROM done")
def committed_txns(spark, sf):
    return recovery.committed(recovery.valid_prefix(d.log(spark, sf)))


@query(f"{d.log_sql(_BAD)} SELECT lsn, txn_id, type, row_id, cust, status FROM ops WHERE lsn > {_CHECKPOINT}")
def redo_ops(spark, sf):
    return recovery.redo_ops(recovery.valid_prefix(d.log(spark, sf, _BAD)), _CHECKPOINT).select("lsn", "txn_id", "type", "row_id", "row.*")


@query(f"{d.log_sql()} SELECT lsn, row_id % 8 AS shard FROM ops")
def redo_shards(spark, sf):
    return recovery.shard(recovery.redo_ops(recovery.valid_prefix(d.log(spark, sf))), 8).select("lsn", "shard")


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"{ROW_ID} bigint, cust bigint, status string")


_NO_ROWS = "SELECT CAST(NULL AS BIGINT) AS row_id, CAST(NULL AS BIGINT) AS cust, CAST(NULL AS VARCHAR) AS status WHERE false"


@query(f"{d.log_sql()}{d.redo_sql('ops', _NO_ROWS)} SELECT row_id AS __row_id__, cust, status FROM outp")
def recover_full(spark, sf):
    return recovery.redo(_nothing(spark), recovery.redo_ops(recovery.valid_prefix(d.log(spark, sf))))


@query(f"{d.log_sql()}{d.redo_sql('ops', _NO_ROWS)} SELECT row_id AS __row_id__, cust, status FROM outp")
def recover_from_checkpoint(spark, sf):
    """Checkpoint plus tail equals the full replay."""
    prefix = recovery.valid_prefix(d.log(spark, sf))
    base = recovery.redo(_nothing(spark), recovery.redo_ops(prefix.where(F.col("lsn") <= _CHECKPOINT)))
    return recovery.redo(base, recovery.redo_ops(prefix, _CHECKPOINT))


@query(f"{d.log_sql(_BAD)} SELECT (SELECT count(*) FROM log) AS records_read, (SELECT count(*) > 0 FROM full_log WHERE lsn = {_BAD}) AS corrupt_record, (SELECT count(*) FROM done) AS committed_transactions, count(*) AS operations_replayed, greatest((SELECT max(lsn) FROM log), {_CHECKPOINT}) AS last_wal_lsn FROM ops WHERE lsn > {_CHECKPOINT}")
def recovery_stats(spark, sf):
    return recovery.recovery_stats(d.log(spark, sf, _BAD), _CHECKPOINT)
