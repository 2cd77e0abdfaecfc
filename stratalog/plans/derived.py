"""Versioned tables, transactions and logs derived from ``orders`` by arithmetic.

Both engines build the same frames from the same SQL, so each operator can be
held against plain SQL. ``k = o_orderkey`` serves as row id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ROW_ID


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROW_ID), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))


def txn(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").select((F.col("o_orderkey") % 97 + 1).alias("txn_id")).distinct()
    state = F.when(F.col("txn_id") % 5 == 0, "ABORTED").when(F.col("txn_id") % 7 == 0, "ACTIVE").otherwise("COMMITTED")
    return t.select("txn_id", (900 + F.col("txn_id")).alias("snapshot_ts"), (1000 + F.col("txn_id")).alias("commit_ts"), state.alias("state"))


def delta(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k, t, zero = F.col("o_orderkey"), F.col("o_orderkey") % 97 + 1, F.lit(0).cast("bigint")

    def row(cust, status: str):
        return F.struct(cust.alias("cust"), F.lit(status).alias("status"))

    none = F.lit(None).cast("struct<cust:bigint,status:string>")
    tomb = o.where(k % 10 < 3).where(k % 10 > 0).select((k * 10).alias("seq"), k.alias("row_id"), zero.alias("created_txn"), t.alias("deleted_txn"), F.lit(True).alias("is_base_tombstone"), none.alias("row"))
    made = o.where(k % 10 == 1).select((k * 10 + 1).alias("seq"), k.alias("row_id"), t.alias("created_txn"), zero.alias("deleted_txn"), F.lit(False).alias("is_base_tombstone"), row(F.col("o_custkey") + 1, "U").alias("row"))
    new = o.where(k % 10 == 3).select((k * 10 + 2).alias("seq"), (k + 1000000000).alias("row_id"), t.alias("created_txn"), zero.alias("deleted_txn"), F.lit(False).alias("is_base_tombstone"), row(F.col("o_custkey"), "N").alias("row"))
    return tomb.unionByName(made).unionByName(new)


def log(spark: SparkSession, sf: str, bad_lsn: int | None = None) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")

    def rec(df: DataFrame, at: int, kind: str, row_id, cust=None, status: str | None = None) -> DataFrame:
        row = F.lit(None).cast("struct<cust:bigint,status:string>") if cust is None else F.struct(cust.cast("bigint").alias("cust"), F.lit(status).alias("status"))
        return df.select((k * 4 + at).alias("lsn"), (k + 1).alias("txn_id"), F.lit(kind).alias("type"), row_id.cast("bigint").alias("row_id"), row.alias("row"))

    earlier = F.floor(k / 2)
    out = rec(o, 0, "INSERT", k, F.col("o_custkey"), "I")
    out = out.unionByName(rec(o.where(k % 10 == 9), 1, "UPDATE", earlier, F.col("o_custkey") + 7, "U"))
    out = out.unionByName(rec(o.where(k % 10 == 8), 1, "DELETE", earlier))
    out = out.unionByName(rec(o.where(k % 7 != 3), 2, "COMMIT", F.lit(None)))
    return out.withColumn("bad", F.lit(False) if bad_lsn is None else F.col("lsn") == bad_lsn)


TXN_SQL = """txn AS (SELECT DISTINCT (o_orderkey % 97) + 1 AS txn_id FROM orders),
st AS (SELECT txn_id, 900 + txn_id AS snapshot_ts, 1000 + txn_id AS commit_ts,
  CASE WHEN txn_id % 5 = 0 THEN 'ABORTED' WHEN txn_id % 7 = 0 THEN 'ACTIVE' ELSE 'COMMITTED' END AS state FROM txn)"""
DELTA_SQL = f"""{TXN_SQL},
delta AS (
  SELECT o_orderkey * 10 AS seq, o_orderkey AS row_id, 0 AS created_txn, (o_orderkey % 97) + 1 AS deleted_txn, true AS tomb, CAST(NULL AS BIGINT) AS cust, CAST(NULL AS VARCHAR) AS status FROM orders WHERE o_orderkey % 10 IN (1, 2)
  UNION ALL SELECT o_orderkey * 10 + 1, o_orderkey, (o_orderkey % 97) + 1, 0, false, o_custkey + 1, 'U' FROM orders WHERE o_orderkey % 10 = 1
  UNION ALL SELECT o_orderkey * 10 + 2, o_orderkey + 1000000000, (o_orderkey % 97) + 1, 0, false, o_custkey, 'N' FROM orders WHERE o_orderkey % 10 = 3),
ds AS (SELECT d.*, coalesce(c.state, 'ACTIVE') AS cs, c.commit_ts AS cts, coalesce(x.state, 'ACTIVE') AS xs, x.commit_ts AS xts
  FROM delta d LEFT JOIN st c ON c.txn_id = d.created_txn LEFT JOIN st x ON x.txn_id = d.deleted_txn)"""


def snapshot_sql(me: int, ts: int) -> str:
    return f"""WITH {DELTA_SQL},
v AS (SELECT *, (created_txn = 0 OR created_txn = {me} OR (cs = 'COMMITTED' AND cts <= {ts})) AS cv,
  (deleted_txn <> 0 AND (deleted_txn = {me} OR (xs = 'COMMITTED' AND xts <= {ts}))) AS dv FROM ds),
live AS (SELECT row_id, cust, status FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY seq DESC) AS rn FROM v WHERE NOT tomb AND cv AND NOT dv) WHERE rn = 1),
sup AS (SELECT row_id FROM v WHERE tomb AND dv UNION SELECT row_id FROM live)
SELECT row_id AS __row_id__, cust, status FROM live
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT row_id FROM sup)"""


def class_sql(watermark: int) -> str:
    return f"""WITH {DELTA_SQL},
cl AS (SELECT *, CASE
  WHEN NOT tomb AND created_txn <> 0 AND cs = 'ABORTED' THEN 'DROPPED'
  WHEN tomb AND xs = 'ABORTED' THEN 'DROPPED'
  WHEN tomb AND xs = 'COMMITTED' AND xts <= {watermark} THEN 'PURGE'
  WHEN tomb THEN 'RETAINED'
  WHEN (created_txn = 0 OR (cs = 'COMMITTED' AND cts <= {watermark})) AND deleted_txn = 0 THEN 'PROMOTED'
  ELSE 'RETAINED' END AS class FROM ds)"""


def log_sql(bad_lsn: int | None = None) -> str:
    cut = "" if bad_lsn is None else f" WHERE lsn < coalesce((SELECT min(lsn) FROM full_log WHERE lsn = {bad_lsn}), 9223372036854775807)"
    return f"""WITH full_log AS (
  SELECT o_orderkey * 4 AS lsn, o_orderkey + 1 AS txn_id, 'INSERT' AS type, o_orderkey AS row_id, o_custkey AS cust, 'I' AS status FROM orders
  UNION ALL SELECT o_orderkey * 4 + 1, o_orderkey + 1, 'UPDATE', o_orderkey // 2, o_custkey + 7, 'U' FROM orders WHERE o_orderkey % 10 = 9
  UNION ALL SELECT o_orderkey * 4 + 1, o_orderkey + 1, 'DELETE', o_orderkey // 2, NULL, NULL FROM orders WHERE o_orderkey % 10 = 8
  UNION ALL SELECT o_orderkey * 4 + 2, o_orderkey + 1, 'COMMIT', NULL, NULL, NULL FROM orders WHERE o_orderkey % 7 <> 3),
log AS (SELECT * FROM full_log{cut}),
done AS (SELECT DISTINCT txn_id FROM log WHERE type = 'COMMIT'),
ops AS (SELECT * FROM log WHERE type IN ('INSERT', 'UPDATE', 'DELETE') AND txn_id IN (SELECT txn_id FROM done))"""


def redo_sql(source: str, held: str) -> str:
    """CTEs ``per`` and ``outp`` over the operations in ``source``; ``held``: a query of base rows."""
    return f""", held AS ({held}), per AS (SELECT row_id, arg_max(struct_pack(c := cust, s := status), lsn) AS r,
  coalesce(max(CASE WHEN type = 'INSERT' THEN lsn END), -1) AS ins, coalesce(max(CASE WHEN type = 'DELETE' THEN lsn END), -1) AS del FROM {source} GROUP BY row_id),
fin AS (SELECT per.*, (ins > del OR (row_id IN (SELECT row_id FROM held) AND del = -1)) AS alive FROM per),
outp AS (SELECT row_id, cust, status FROM held WHERE row_id NOT IN (SELECT row_id FROM fin WHERE alive OR del > -1)
  UNION ALL SELECT row_id, r.c, r.s FROM fin WHERE alive)"""
