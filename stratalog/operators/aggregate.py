"""SUM and fused filter-sum-count with three execution strategies.

``codegen``  whole-stage codegen fuses filter and partial sum (default)
``row``      the same plan in a session without whole-stage codegen
``arrow``    Arrow batches through a vectorised kernel, partials summed by Spark
"""

from __future__ import annotations

import platform
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WRAP = 1 << 64


def _sum(column: Column, overflow: str) -> Column:
    if overflow == "error":
        return F.coalesce(F.sum(column), F.lit(0).cast("bigint"))
    if overflow != "wrap":
        raise ValueError(overflow)
    total = F.coalesce(F.sum(column.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    whole, half = (F.lit(str(x)).cast("decimal(20,0)") for x in (_WRAP, _WRAP >> 1))
    low = F.pmod(total, whole)
    return F.when(low >= half, low - whole).otherwise(low).cast("bigint")


def _need_integers(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if not isinstance(df.schema[c].dataType, (T.IntegerType, T.LongType)):
            raise TypeError(f"{c} is not an integer column")


def scan_sum(df: DataFrame, column: str, overflow: str = "error") -> DataFrame:
    """One row ``(sum)``; 0 for no rows. ``overflow``: error, or wrap modulo 2^64."""
    _need_integers(df, column)
    return df.select(column).agg(_sum(F.col(column), overflow).alias("sum"))


def filter_gt_sum(df: DataFrame, pred: str, agg: str, threshold: int, *, nulls: str = "sql", overflow: str = "error", arrow: bool = False) -> DataFrame:
    """One row ``(sum, matched_count)`` over rows with ``pred > threshold``.

    ``nulls="sql"``: a NULL predicate never matches, a NULL value adds nothing but
    is counted. ``nulls="zero"``: NULLs read as 0 in both columns.
    """
    _need_integers(df, pred, agg)
    df = df.select(F.col(pred).cast("bigint").alias("p"), F.col(agg).cast("bigint").alias("a"))
    if nulls == "zero":
        df = df.select(*(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("p", "a")))
    if arrow:
        df = df.mapInArrow(_partial(threshold), "a bigint, n bigint")
        return df.agg(_sum(F.col("a"), overflow).alias("sum"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("matched_count"))
    return df.where(F.col("p") > F.lit(threshold).cast("bigint")).agg(_sum(F.col("a"), overflow).alias("sum"), F.count(F.lit(1)).alias("matched_count"))


def _partial(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.filter(pc.greater(b.column(0), pa.scalar(threshold, pa.int64())))
            total = pc.sum(kept.column(1)).as_py() if kept.num_rows else 0
            yield pa.RecordBatch.from_pydict({"a": pa.array([total], pa.int64()), "n": pa.array([kept.num_rows], pa.int64())})

    return run


def strategy_session(spark: SparkSession, strategy: str) -> SparkSession:
    """A session of the same context whose plans run by ``strategy``."""
    own = spark.newSession()
    own.conf.set("spark.sql.codegen.wholeStage", str(strategy != "row").lower())
    if strategy == "arrow":
        own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    return own


def capabilities(spark: SparkSession) -> dict[str, str | int]:
    """What the strategies can build on: cores, machine, and the settings that choose between them."""
    names = {"codegen": "spark.sql.codegen.wholeStage", "vectorized_reader": "spark.sql.parquet.enableVectorizedReader", "adaptive": "spark.sql.adaptive.enabled"}
    return {"cores": spark.sparkContext.defaultParallelism, "machine": platform.machine(), "spark": spark.version} | {k: spark.conf.get(v) for k, v in names.items()}
