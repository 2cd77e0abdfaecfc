"""Compaction: fold versions that every reader agrees on into the base.

``stable`` means committed at or before the watermark. Versions of aborted
creators go; an aborted deleter is forgotten; a stable tombstone purges its base
row whether or not newer versions exist; stable live versions are promoted;
stable dead ones retired; the rest is retained. No reader's view changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ROW_ID
from .mvcc import with_status


@dataclass
class Compacted:
    base: DataFrame
    delta: DataFrame
    classes: DataFrame

    def metrics(self) -> DataFrame:
        def of(*names: str):
            return F.count_if(F.col("class").isin(*names)).alias(f"rows_{names[0].lower()}")

        return self.classes.agg(of("PROMOTED"), of("RETIRED", "DROPPED", "PURGE"), of("RETAINED"))


def classify(delta: DataFrame, txn: DataFrame, watermark: int) -> DataFrame:
    def stable(side: str):
        return (F.col(f"{side}_state") == "COMMITTED") & (F.col(f"{side}_ts") <= watermark)

    v = with_status(delta, txn)
    undone = (F.col("deleted_txn") != 0) & (F.col("d_state") == "ABORTED")
    born = (F.col("created_txn") == 0) | F.coalesce(stable("c"), F.lit(False))
    dead = (F.col("deleted_txn") != 0) & F.coalesce(stable("d"), F.lit(False))
    tomb = F.col("is_base_tombstone")
    kind = (
        F.when(~tomb & (F.col("created_txn") != 0) & (F.col("c_state") == "ABORTED"), "DROPPED")
        .when(tomb & undone, "DROPPED")
        .when(tomb & dead, "PURGE")
        .when(tomb, "RETAINED")
        .when(born & ((F.col("deleted_txn") == 0) | undone), "PROMOTED")
        .when(born & dead, "RETIRED")
        .otherwise("RETAINED")
    )
    return v.withColumn("class", kind).withColumn("deleted_txn", F.when(undone, F.lit(0).cast("bigint")).otherwise(F.col("deleted_txn"))).select(*delta.columns, "class")


def compact(base: DataFrame, delta: DataFrame, txn: DataFrame, watermark: int) -> Compacted:
    c = classify(delta, txn, watermark)
    gone = c.where(F.col("class") == "PURGE").select("row_id")
    promoted = c.where(F.col("class") == "PROMOTED").select(F.col("row_id").alias(ROW_ID), "row.*")
    kept = base.join(gone, base[ROW_ID] == gone["row_id"], "left_anti")
    return Compacted(kept.unionByName(promoted), c.where(F.col("class") == "RETAINED").drop("class"), c)
