"""Log analysis and redo as set operations over log rows.

Records hold whole rows and no operation depends on other rows, so replay in log
order comes down to the last operation of each row; see ``redo``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ROW_ID

_OPS = ("INSERT", "UPDATE", "DELETE")


def first_hole(log: DataFrame, first_lsn: int, span: int = 1 << 16) -> DataFrame:
    """One row ``_hole``: the least LSN from ``first_lsn`` on that no good record has, though a later one is there.

    Records are counted in spans of LSNs; only spans whose count does not fit are sorted.
    The window over all spans has a row for each ``span`` records.
    """
    good = log.where(~F.col("bad") & (F.col("lsn") >= first_lsn)).select("lsn", F.expr(f"lsn div {span}").alias("_span"))
    per = good.groupBy("_span").agg(F.min("lsn").alias("_low"), F.max("lsn").alias("_high"), F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_prev", F.coalesce(F.lag("_high").over(Window.orderBy("_span")), F.lit(first_lsn - 1)))
    unlike = per.where((F.col("_low") != F.col("_prev") + 1) | (F.col("_high") - F.col("_low") + 1 != F.col("_n"))).select("_span", "_prev")
    before = F.coalesce(F.lag("lsn").over(Window.partitionBy("_span").orderBy("lsn")), F.col("_prev"))
    return good.join(unlike, "_span").withColumn("_before", before).where(F.col("lsn") > F.col("_before") + 1).agg((F.min("_before") + 1).alias("_hole"))


def _cut(log: DataFrame, first_lsn: int | None) -> DataFrame:
    """One row ``_cut, _hole``: where trust ends (NULL: nowhere), and the first missing LSN."""
    bad = log.where(F.col("bad")).agg(F.min("lsn").alias("_bad"))
    hole = bad.withColumn("_hole", F.lit(None).cast("bigint")) if first_lsn is None else bad.join(F.broadcast(first_hole(log, first_lsn)))
    return hole.select(F.least("_bad", "_hole").alias("_cut"), "_hole")  # least skips NULLs


def valid_prefix(log: DataFrame, first_lsn: int | None = None) -> DataFrame:
    """Records before the first bad one; nothing after it is trusted. ``log`` has ``lsn`` and ``bad``.

    With ``first_lsn`` the LSNs from there on must be dense, and a missing one cuts as a bad one does.
    """
    kept = F.col("_cut").isNull() | (F.col("lsn") < F.col("_cut"))
    return log.join(F.broadcast(_cut(log, first_lsn))).where(kept).drop("_cut", "_hole", "bad", "torn")  # one row is broadcast


def log_stats(log: DataFrame, first_lsn: int | None = None) -> DataFrame:
    """One row: records read, last valid LSN (0 if none), whether a bad record was met.

    With ``first_lsn`` also ``truncated_tail``: a record is torn (column ``torn``, if there)
    or missing without any bad one to account for it. With a column ``bytes`` also ``bytes_read``.
    """
    made = [F.count(F.lit(1)).alias("records_read"), F.coalesce(F.max("lsn"), F.lit(0).cast("bigint")).alias("last_valid_lsn")]
    if "bytes" in log.columns:
        made.append(F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes_read"))
    torn = F.col("torn") if "torn" in log.columns else F.lit(False)
    bad = log.agg(F.coalesce(F.bool_or(F.col("bad") & ~torn), F.lit(False)).alias("corrupt_record"), F.coalesce(F.bool_or(torn), F.lit(False)).alias("_torn"))
    if first_lsn is not None:
        missing = F.col("_hole").isNotNull() & ~F.col("corrupt_record")
        bad = bad.join(F.broadcast(first_hole(log, first_lsn))).withColumn("truncated_tail", F.col("_torn") | missing).drop("_hole")
    return valid_prefix(log, first_lsn).agg(*made).join(F.broadcast(bad.drop("_torn")))


def committed(prefix: DataFrame) -> DataFrame:
    return prefix.where(F.col("type") == "COMMIT").select("txn_id").distinct()


def redo_ops(prefix: DataFrame, checkpoint_lsn: int = -1) -> DataFrame:
    """Data operations after the checkpoint whose transaction committed; the rest is undone by omission."""
    ops = prefix.where(F.col("type").isin(*_OPS) & (F.col("lsn") > checkpoint_lsn))
    return ops.join(committed(prefix), "txn_id", "left_semi")


def shard(ops: DataFrame, shards: int) -> DataFrame:
    return ops.withColumn("shard", F.pmod(F.col("row_id"), F.lit(shards)))


def final_rows(ops: DataFrame, base: DataFrame) -> DataFrame:
    """Per touched row: ``alive``, ``removed`` and the last image."""
    at = {k: F.coalesce(F.max(F.when(F.col("type") == k, F.col("lsn"))), F.lit(-1)) for k in ("INSERT", "DELETE")}
    per = ops.groupBy("row_id").agg(F.max_by("row", "lsn").alias("row"), at["INSERT"].alias("_ins"), at["DELETE"].alias("_del"))
    held = base.select(F.col(ROW_ID).alias("row_id"), F.lit(True).alias("_held"))
    per = per.join(held, "row_id", "left")
    alive = (F.col("_ins") > F.col("_del")) | (F.coalesce("_held", F.lit(False)) & (F.col("_del") == -1))
    return per.select("row_id", "row", alive.alias("alive"), (F.col("_del") > -1).alias("removed"))


def redo(base: DataFrame, ops: DataFrame) -> DataFrame:
    """The table after the operations. Updates and deletes of rows that never were have no effect."""
    last = final_rows(ops, base)
    touched = last.where(F.col("alive") | F.col("removed")).select("row_id")
    kept = base.join(touched, base[ROW_ID] == touched["row_id"], "left_anti")
    return kept.unionByName(last.where("alive").select(F.col("row_id").alias(ROW_ID), "row.*"))


def recovery_stats(log: DataFrame, checkpoint_lsn: int = -1, first_lsn: int | None = None) -> DataFrame:
    """One row; with ``first_lsn`` missing records are looked for, see ``log_stats``."""
    prefix = valid_prefix(log, first_lsn)
    ops = redo_ops(prefix, checkpoint_lsn).agg(F.count(F.lit(1)).alias("operations_replayed"))
    txns = committed(prefix).agg(F.count(F.lit(1)).alias("committed_transactions"))
    last = F.greatest(F.col("last_valid_lsn"), F.lit(checkpoint_lsn)).alias("last_wal_lsn")
    read = log_stats(log, first_lsn)
    more = [c for c in ("truncated_tail", "bytes_read") if c in read.columns]
    return read.join(F.broadcast(ops)).join(F.broadcast(txns)).select("records_read", "corrupt_record", "committed_transactions", "operations_replayed", last, *more)
