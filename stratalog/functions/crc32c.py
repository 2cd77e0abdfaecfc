"""CRC-32C (Castagnoli), which Spark lacks: a vectorised Arrow-batch UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the reflected Castagnoli polynomial.
POLYNOMIAL = 0x82F63B78


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_TABLE = _table()


def crc32c(data: bytes, partial: int = 0) -> int:
    """Checksum of ``data``; ``partial`` continues an earlier one."""
    c = partial ^ 0xFFFFFFFF
    for b in data:
        c = int(_TABLE[(c ^ b) & 255]) ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def crc32c_many(values: list[bytes | None]) -> list[int | None]:
    """All rows advance together, one byte position at a time; longest first so that finished rows fall away."""
    order = sorted((i for i, v in enumerate(values) if v is not None), key=lambda i: -len(values[i]))
    out: list[int | None] = [None] * len(values)
    sizes = np.array([len(values[i]) for i in order], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(order) else sizes
    flat = np.frombuffer(b"".join(values[i] for i in order), dtype=np.uint8)
    c = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    live = len(order)
    for p in range(int(sizes[0]) if len(order) else 0):
        while live and sizes[live - 1] <= p:
            live -= 1
        c[:live] = _TABLE[(c[:live] ^ flat[starts[:live] + p]) & 255] ^ (c[:live] >> np.uint32(8))
    for k, i in enumerate(order):
        out[i] = int(c[k] ^ np.uint32(0xFFFFFFFF))
    return out


@F.pandas_udf(T.LongType())
def crc32c_column(data: pd.Series) -> pd.Series:
    return pd.Series(crc32c_many([None if x is None else bytes(x) for x in data]), dtype="Int64")


def record_crc(*columns: Column) -> Column:
    """Checksum over the length-delimited JSON form of the columns, so that neighbours cannot run together."""
    parts = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return crc32c_column(F.encode(parts, "UTF-8"))


def segment_checksums(df: DataFrame, segment: str, column: str) -> DataFrame:
    """Per segment: number of cells and an order-free sum of cell checksums, NULLs counted apart."""
    cell = F.encode(F.col(column).cast("string"), "UTF-8")
    return df.select(segment, crc32c_column(cell).alias("_c")).groupBy(segment).agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("_c"), F.lit(0)).alias("checksum"))
