"""Vectorised text scanning over Arrow batches, and helpers that all operators share.

Texts of a slice are viewed as one byte buffer. Words are runs of bytes of a
class, so UTF-8 letters stay whole as long as all bytes from 0x80 are in it.
Hashes are polynomial over bytes modulo 2^64, taken from prefix sums, and mixed.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: Bytes of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

SLICE_BYTES = 2 << 20

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where the tables of ``checkpoint`` lie, by the identity of their frames.
_stored: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.encode(c.cast("string"), "UTF-8")), F.lit(modulus))


def shared_folder(spark: SparkSession) -> str:
    """A new path under the shared folder that the session names; tests without one get it under the warehouse."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table written to the shared folder; lost executors take nothing of it along.

    Shuffle files of the job that writes it go when it ends, as nothing can read them again.
    ``discard`` deletes the table; what an operator returns may still read those it keeps.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[id(out)] = path
    weakref.finalize(out, _stored.pop, id(out), None)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``checkpoint`` wrote, once no later job reads them; others and None are left alone."""
    for t in tables:
        if t is not None and (path := _stored.pop(id(t), None)):
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        p = np.full(size, base, dtype=U64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if size <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about ``limit`` bytes of text each, at least one row."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield b.slice(lo, hi - lo)


class Words:
    """Words of the texts of one slice: byte ranges, hashes, and ranges of words by document."""

    def __init__(self, column: pa.Array, kind: np.ndarray, lower: bool = True) -> None:
        raw, self.offsets = buffer(column)
        self.bytes = ASCII_LOWER[raw] if lower else raw
        n = len(self.bytes)
        inside = kind[self.bytes]
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        o = self.offsets
        before[o[:-1][o[:-1] < n]] = False
        after[o[1:][o[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, o)  # of each document, and the end

    def hashes(self) -> np.ndarray:
        n = len(self.bytes)
        if not n:
            return np.zeros(0, U64)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum((self.bytes.astype(U64) + U64(1)) * _power("r", _R, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * _power("inverse", _R_INVERSE, n)[self.start]
        return mix(h + (self.end - self.start).astype(U64))

    def text(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by its first word; across documents too."""
    if len(h) < k:
        return np.zeros(0, U64)
    m = len(h) - k + 1
    out = np.zeros(m, U64)
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + h[j : j + m]
    return mix(out)


def run_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Word numbers from which k words lie in one document."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    return np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """``_row`` with all columns, and the needed ones beside it, so that further columns cannot clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(f"`{c}`") for c in needed])


def filtered(df: DataFrame, needed: list[str], keep: Callable[[pa.RecordBatch], np.ndarray], text: str = "text") -> DataFrame:
    """Rows for which ``keep`` of the slice is true, with their columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["_row"]).filter(pa.array(keep(b)))

    p = packed(df, *needed)
    return p.mapInArrow(run, p.select("_row").schema).select("_row.*")


def vector_rows(total: np.ndarray, slice_size: int = 1 << 14) -> pa.RecordBatch:
    """A task's flat float64 vector as one row per slice, for ``sum_vectors``."""
    flat = np.ascontiguousarray(total, dtype=np.float64).ravel()
    parts = [flat[i : i + slice_size] for i in range(0, len(flat), slice_size)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "data"])


def sum_vectors(df: DataFrame, size: int, ways: int = 64) -> np.ndarray:
    """Sum of the vectors of all tasks: slices are added up by ``ways`` tasks each and then by one, row after row; the driver gets one vector of ``size``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "data"])
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != held:
                    if held is not None:
                        yield row()
                    held, total = k, np.zeros(len(x.as_buffer()) // 8)
                total += np.frombuffer(x.as_buffer(), np.float64)
        if held is not None:
            yield row()

    kind = "slice int, data binary"
    dealt = df.withColumn("way", F.pmod(F.spark_partition_id(), F.lit(ways))).repartition("slice", "way").sortWithinPartitions("slice").select("slice", "data")
    whole = dealt.mapInArrow(add, kind).repartition("slice").sortWithinPartitions("slice").mapInArrow(add, kind)
    got = sorted((r["slice"], bytes(r["data"])) for r in whole.collect())
    return np.concatenate([np.frombuffer(x, np.float64) for _, x in got]) if got else np.zeros(size)
