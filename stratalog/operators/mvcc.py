"""Visibility, snapshot merge, write claims and the compaction watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ROW_ID, Reader

_COMMITTED, _ACTIVE, _ABORTED = "COMMITTED", "ACTIVE", "ABORTED"


def with_status(delta: DataFrame, txn: DataFrame) -> DataFrame:
    """Adds the state and commit time of creator (c_) and deleter (d_); unknown ids count as active.

    The join is left to the planner: it is broadcast only while the status table is small.
    """
    for side, key in (("c", "created_txn"), ("d", "deleted_txn")):
        st = txn.select(F.col("txn_id").alias(key), F.col("state").alias(f"{side}_state"), F.col("commit_ts").alias(f"{side}_ts"))
        delta = delta.join(st, key, "left").withColumn(f"{side}_state", F.coalesce(f"{side}_state", F.lit(_ACTIVE)))
    return delta


def created_visible(reader: Reader) -> Column:
    return (F.col("created_txn") == 0) | (F.col("created_txn") == reader.txn_id) | ((F.col("c_state") == _COMMITTED) & (F.col("c_ts") <= reader.snapshot_ts))


def deleted_visible(reader: Reader) -> Column:
    seen = (F.col("deleted_txn") == reader.txn_id) | ((F.col("d_state") == _COMMITTED) & (F.col("d_ts") <= reader.snapshot_ts))
    return (F.col("deleted_txn") != 0) & F.coalesce(seen, F.lit(False))


def newest(df: DataFrame, key: str = "row_id", order: str = "seq") -> DataFrame:
    """The row with the largest ``order`` of each key, by partial aggregation."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_v")).select(key, "_v.*")


def snapshot_read(base: DataFrame, delta: DataFrame, txn: DataFrame, reader: Reader) -> DataFrame:
    """Rows that ``reader`` sees: newest visible version of each row, and base rows not hidden by one."""
    seen = with_status(delta, txn).withColumn("_c", F.coalesce(created_visible(reader), F.lit(False))).withColumn("_d", deleted_visible(reader))
    live = newest(seen.where(~F.col("is_base_tombstone") & F.col("_c") & ~F.col("_d")).select("row_id", "seq", "row"))
    hidden = seen.where(F.col("is_base_tombstone") & F.col("_d")).select("row_id").union(live.select("row_id"))
    kept = base.join(hidden, base[ROW_ID] == hidden["row_id"], "left_anti")
    return kept.unionByName(live.select(F.col("row_id").alias(ROW_ID), "row.*"))


def claim_outcomes(writes: DataFrame, delta: DataFrame, txn: DataFrame, base: DataFrame, me: Reader) -> DataFrame:
    """``(row_id, outcome, seq)`` for each row to write, at most one write a row.

    ``seq``: the version to claim; NULL with OK means a new tombstone over a base row.
    """
    v = with_status(delta.join(writes.select("row_id"), "row_id", "left_semi"), txn)
    mine, untouched = F.col("deleted_txn") == me.txn_id, F.col("deleted_txn") == 0
    kind = (
        F.when(mine | (~untouched & (F.col("d_state") == _COMMITTED)), "SKIP")
        .when(~untouched & (F.col("d_state") == _ACTIVE), "CONFLICT")
        .when(F.coalesce(created_visible(me), F.lit(False)), "OK")
        .otherwise("SKIP")
    )
    v = v.withColumn("_k", kind)
    told = v.groupBy("row_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("_k") != "SKIP", F.struct("seq", "_k"))).alias("_top"))
    held = base.select(F.col(ROW_ID).alias("row_id"), F.lit(True).alias("_base"))
    joined = writes.select("row_id").join(told, "row_id", "left").join(held, "row_id", "left")
    outcome = F.when(F.col("_top").isNotNull(), F.col("_top._k")).when(F.col("_n").isNull() & F.col("_base"), "OK").otherwise("NOT_FOUND")
    return joined.select("row_id", outcome.alias("outcome"), F.col("_top.seq").alias("seq"))


def oldest_active_snapshot(txn: DataFrame) -> DataFrame:
    """One row ``(watermark)``: least snapshot of an active transaction, else the last commit, else 0."""
    active = F.min(F.when(F.col("state") == _ACTIVE, F.col("snapshot_ts")))
    last = F.max(F.when(F.col("state") == _COMMITTED, F.col("commit_ts")))
    return txn.agg(F.coalesce(active, last, F.lit(0)).cast("bigint").alias("watermark"))


def active_txn_count(txn: DataFrame) -> DataFrame:
    return txn.agg(F.count_if(F.col("state") == _ACTIVE).alias("active"))
