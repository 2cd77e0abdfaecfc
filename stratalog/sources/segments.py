"""Base segments: immutable Parquet files, with a table of statistics and checksums beside each directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crc32c import segment_checksums
from ..operators.predicate import can_skip, typed_literal
from ..operators.stats import column_stats
from ..schema import PredicateOp, base_schema, check_same_schema


class DamagedSegment(Exception):
    """Files of the base are missing, new or changed."""


def file_stats(found: DataFrame, cells: bool = True) -> DataFrame:
    """Per file: rows and, if ``cells``, a checksum of the rows in any order, min, max and null count of each column."""
    names = found.columns
    made = [F.count(F.lit(1)).alias("row_count")]
    if cells:
        made += [F.bit_xor(F.xxhash64(*names)).alias("checksum"), *column_stats(names)]
    return found.select(F.col("_metadata.file_name").alias("file"), *names).groupBy("file").agg(*made)


def write_base(df: DataFrame, path: str, user: T.StructType, rows_per_file: int = 1_000_000) -> None:
    """Writes a new directory, never one that may be read; files are cut by rows so that zone maps stay narrow."""
    schema = base_schema(user)
    check_same_schema(df.schema, schema)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    file_stats(df.sparkSession.read.schema(schema).parquet(path)).coalesce(1).write.parquet(f"{path}.stats")


def read_base(spark: SparkSession, paths: list[str], user: T.StructType) -> DataFrame:
    """Directories or single files; every page is held against its checksum as it is read."""
    schema = base_schema(user)
    if not paths:
        return spark.createDataFrame([], schema)
    found = spark.read.option("parquet.page.verify-checksum.enabled", "true").parquet(*paths)
    check_same_schema(T.StructType([found.schema[f.name] for f in schema if f.name in found.columns]), schema)
    return found.select(*[f.name for f in schema])


def live_files(spark: SparkSession, paths: list[str], column: str, dtype: T.DataType, op: PredicateOp, value) -> list[str]:
    """Files that the stored statistics cannot exclude; the driver holds a name for each, as for any scan."""
    keep = ~can_skip(op, F.col(f"{column}_min"), F.col(f"{column}_max"), typed_literal(dtype, value))
    return [f"{p}/{r['file']}" for p in paths for r in spark.read.parquet(f"{p}.stats").where(keep).select("file").collect()]


def damaged(spark: SparkSession, path: str, user: T.StructType, cells: bool = True) -> DataFrame:
    """Files of a directory whose rows (``cells``: contents too) differ from the stored ones, with both row counts."""
    want = spark.read.parquet(f"{path}.stats").select("file", F.col("row_count").alias("wanted_rows"), *([F.col("checksum").alias("_want")] if cells else []))
    found = file_stats(spark.read.schema(base_schema(user)).parquet(path), cells).withColumnRenamed("row_count", "found_rows")
    same = F.col("wanted_rows").eqNullSafe(F.col("found_rows"))
    if cells:
        same &= F.col("_want").eqNullSafe(F.col("checksum"))
    return want.join(found, "file", "full").where(~same).select("file", "wanted_rows", "found_rows")


def check_base(spark: SparkSession, paths: list[str], user: T.StructType, cells: bool = False) -> None:
    """Raises if files are missing or their row counts differ; with ``cells`` contents are read and compared."""
    for p in paths:
        bad = [r["file"] for r in damaged(spark, p, user, cells).limit(20).collect()]
        if bad:
            raise DamagedSegment(f"{p}: {', '.join(sorted(bad))}")


def verify(df: DataFrame, expected: DataFrame, segment: str, column: str) -> DataFrame:
    """``(segment, damaged)``: whether the CRC-32C sum of ``column`` or its cells differ from ``expected`` (segment, cells, checksum)."""
    found = segment_checksums(df, segment, column)
    e = expected.toDF(segment, "_cells", "_sum")
    same = F.col("checksum").eqNullSafe(F.col("_sum")) & F.col("cells").eqNullSafe(F.col("_cells"))
    return found.join(e, segment, "full").select(segment, (~same).alias("damaged"))
