"""Write-ahead log: a directory per append, JSON lines with a checksum each."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crc32c import crc32c, record_crc
from ..schema import Durability, RecordType, log_schema
from .store import Store

_FIELDS = ("lsn", "txn_id", "type", "row_id", "row")


def checksummed(records: DataFrame) -> DataFrame:
    """``(lsn, txn_id, type, row_id, row, crc)``."""
    return records.select(*_FIELDS).withColumn("crc", record_crc(*(F.col(c) for c in _FIELDS)))


class LogWriter:
    """Appends under the caller's lock. Row batches are written by executors, control records by the driver."""

    def __init__(self, store: Store, next_lsn: int, durability: Durability = Durability.SYNC_EVERY_COMMIT) -> None:
        self.store, self.next_lsn, self.durability = store, next_lsn, durability
        self.unsynced: list[str] = []

    def control(self, txn_id: int, kind: RecordType) -> int:
        lsn = self.next_lsn
        body = {"lsn": lsn, "txn_id": txn_id, "type": kind.name, "row_id": None, "row": None}
        body["crc"] = crc32c(json.dumps(body, separators=(",", ":")).encode())
        if kind is RecordType.COMMIT:
            # Rows reach the disk before the record that makes them count.
            if self.durability is Durability.SYNC_EVERY_COMMIT:
                for name in self.unsynced:
                    self.store.sync(name)
            self.unsynced = []
        sync = self.durability is Durability.SYNC_EVERY_RECORD or (kind is RecordType.COMMIT and self.durability is Durability.SYNC_EVERY_COMMIT)
        self.store.write(f"log/{lsn:020d}/record.json", json.dumps(body, separators=(",", ":")) + "\n", sync)
        self.next_lsn += 1
        return lsn

    def rows(self, txn_id: int, kind: RecordType, ops: DataFrame, count: int) -> int:
        """``ops``: ``(n, row_id, row)`` with n dense from 0; its LSNs are n after the next one."""
        first = self.next_lsn
        records = ops.select((F.col("n") + first).alias("lsn"), F.lit(txn_id).cast("bigint").alias("txn_id"), F.lit(kind.name).alias("type"), "row_id", "row")
        checksummed(records).write.option("ignoreNullFields", "false").json(self.store.path(f"log/{first:020d}"))
        if self.durability is Durability.SYNC_EVERY_RECORD:
            self.store.sync(f"log/{first:020d}")
        else:
            self.unsynced.append(f"log/{first:020d}")
        self.next_lsn += count
        return first


def read_log(spark: SparkSession, store: Store, user: T.StructType) -> DataFrame:
    """The log with ``bad`` (unparsable or failing its checksum), ``torn`` (bad, and the line ends early) and ``bytes``.

    A missing log is empty. A bad record has the first LSN of its append.
    """
    schema = log_schema(user)
    if not store.names("log"):
        return spark.createDataFrame([], schema).select("*", F.lit(False).alias("bad"), F.lit(False).alias("torn"), F.lit(0).alias("bytes"))
    raw = spark.read.schema(T.StructType([*schema.fields, T.StructField("_line", T.StringType())])).option("columnNameOfCorruptRecord", "_line").json(store.path("log/*"))
    at = F.regexp_extract(F.col("_metadata.file_path"), r"/log/(\d+)/", 1).cast("bigint")
    good = F.col("lsn").isNotNull() & F.col("txn_id").isNotNull() & F.col("crc").eqNullSafe(record_crc(*(F.col(c) for c in _FIELDS)))
    size = F.octet_length(F.to_json(F.struct(*_FIELDS, "crc"), {"ignoreNullFields": "false"})) + 1
    marked = raw.withColumn("bad", ~good).withColumn("lsn", F.when(F.col("bad"), at).otherwise(F.col("lsn")))
    return marked.withColumn("torn", F.col("_line").isNotNull() & ~F.rtrim("_line").endswith("}")).withColumn("bytes", size).drop("_line")
