"""Segment statistics, validity counts, dictionaries and dense row ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ROW_ID, PredicateOp
from .predicate import can_skip, compare, typed_literal


def column_stats(columns: list[str]) -> list[Column]:
    return [a for c in columns for a in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), (F.count(F.lit(1)) - F.count(c)).alias(f"{c}_nulls"))]


def segment_stats(df: DataFrame, segment: str, columns: list[str]) -> DataFrame:
    """Per segment: rows and, for each column, min, max and null count. NULLs do not enter min and max."""
    return df.groupBy(segment).agg(F.count(F.lit(1)).alias("row_count"), *column_stats(columns))


def skip_report(stats: DataFrame, column: str, dtype, op: PredicateOp, value) -> DataFrame:
    return stats.withColumn("skipped", can_skip(op, F.col(f"{column}_min"), F.col(f"{column}_max"), typed_literal(dtype, value)))


def pruned_where(df: DataFrame, stats: DataFrame, segment: str, column: str, op: PredicateOp, value) -> DataFrame:
    """``where(column op value)`` reading only the segments that the statistics cannot exclude."""
    dtype = df.schema[column].dataType
    live = skip_report(stats, column, dtype, op, value).where(~F.col("skipped")).select(segment)
    return df.join(live, segment, "left_semi").where(compare(F.col(column), op, typed_literal(dtype, value)))


def validity_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column the number of valid and of NULL cells and whether all are valid."""
    made = []
    for c in columns:
        made += [F.count(c).alias(f"{c}_valid"), (F.count(F.lit(1)) - F.count(c)).alias(f"{c}_nulls"), (F.count(F.lit(1)) == F.count(c)).alias(f"{c}_all_valid")]
    return df.agg(*made)


def dense_ids(df: DataFrame, key: str, name: str, start: int = 0, buckets: int = 64) -> DataFrame:
    """``start, start + 1, …`` in the order of the unique integer ``key``.

    Rows are cut into ``buckets`` key ranges by approximate quantiles; only the
    bucket counts are summed in order, so no task sorts the whole table.
    """
    cuts = df.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 10000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = reduce(lambda a, b: a + b, [(F.col(key) > F.lit(c)).cast("int") for c in cuts], F.lit(0))
    cut = df.withColumn("_b", bucket)
    # At most `buckets` rows: a running total over them is small whatever the table's size.
    per = cut.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = cut.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    return ranked.join(F.broadcast(before), "_b").withColumn(name, (F.lit(start) + F.col("_before") + F.col("_r") - 1).cast("bigint")).drop("_b", "_r", "_before")


def assign_row_ids(df: DataFrame, key: str, start: int = 1) -> DataFrame:
    return dense_ids(df, key, ROW_ID, start)


def dictionary(df: DataFrame, value: str, position: str) -> DataFrame:
    """``(value, code)``: codes count distinct non-null values by their first position."""
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(position).alias("_first"))
    return dense_ids(first, "_first", "code").drop("_first")


def rebuild_dictionary(spark: SparkSession, values: list[str], value: str) -> DataFrame:
    """``(value, code)`` from values in code order, as a dictionary was stored."""
    if len(set(values)) != len(values) or None in values:
        raise ValueError("a dictionary holds each value once and no NULL")
    return spark.createDataFrame([(values,)], "v array<string>").select(F.posexplode("v").alias("code", value)).select(value, F.col("code").cast("bigint").alias("code"))


def encode(df: DataFrame, words: DataFrame, value: str) -> DataFrame:
    """NULL, or a value that the dictionary lacks, has a NULL code."""
    return df.join(words, value, "left")


def decode(df: DataFrame, words: DataFrame, value: str) -> DataFrame:
    return df.join(words.withColumnRenamed(value, f"{value}_decoded"), "code", "left")
