"""Types, schemas and enumerations shared by every module.

Four user types exist (int32, int64, double, string); every column is nullable
and the user schema is supplied by the caller, never inferred.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum, IntEnum

from pyspark.sql import types as T

ROW_ID = "__row_id__"


class ColumnType(Enum):
    INT32 = T.IntegerType()
    INT64 = T.LongType()
    DOUBLE = T.DoubleType()
    STRING = T.StringType()


class PredicateOp(Enum):
    EQ = "="
    NE = "!="
    LT = "<"
    LE = "<="
    GT = ">"
    GE = ">="


class RecordType(IntEnum):
    BEGIN = 1
    INSERT = 2
    UPDATE = 3
    DELETE = 4
    COMMIT = 5
    ABORT = 6


class TxnState(Enum):
    ACTIVE = "ACTIVE"
    COMMITTED = "COMMITTED"
    ABORTED = "ABORTED"


class WriteOutcome(Enum):
    OK = "OK"
    NOT_FOUND = "NOT_FOUND"
    CONFLICT = "CONFLICT"


class Durability(Enum):
    NO_SYNC = "NO_SYNC"
    SYNC_EVERY_COMMIT = "SYNC_EVERY_COMMIT"
    SYNC_EVERY_RECORD = "SYNC_EVERY_RECORD"


@dataclass(frozen=True)
class Reader:
    """Who reads: own writes are visible, others' up to ``snapshot_ts``."""

    txn_id: int
    snapshot_ts: int


def user_schema(**columns: ColumnType) -> T.StructType:
    return T.StructType([T.StructField(n, c.value, True) for n, c in columns.items()])


def check_user_schema(schema: T.StructType) -> None:
    allowed = {c.value for c in ColumnType}
    for f in schema:
        if f.dataType not in allowed:
            raise TypeError(f"{f.name}: {f.dataType.simpleString()} is not one of int, bigint, double, string")
        if f.name == ROW_ID:
            raise ValueError(f"{ROW_ID} is reserved")


def check_same_schema(found: T.StructType, wanted: T.StructType) -> None:
    """Exact equality of names and types: nothing is widened or cast."""
    a = [(f.name, f.dataType) for f in found]
    b = [(f.name, f.dataType) for f in wanted]
    if a != b:
        raise TypeError(f"schema {found.simpleString()} does not equal {wanted.simpleString()}")


def base_schema(user: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(ROW_ID, T.LongType()), *user.fields])


def delta_schema(user: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("seq", T.LongType()),
            T.StructField("row_id", T.LongType()),
            T.StructField("created_txn", T.LongType()),
            T.StructField("deleted_txn", T.LongType()),
            T.StructField("is_base_tombstone", T.BooleanType()),
            T.StructField("row", user),
        ]
    )


TXN_SCHEMA = T.StructType(
    [
        T.StructField("txn_id", T.LongType()),
        T.StructField("snapshot_ts", T.LongType()),
        T.StructField("commit_ts", T.LongType()),
        T.StructField("state", T.StringType()),
    ]
)


def log_schema(user: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("lsn", T.LongType()),
            T.StructField("txn_id", T.LongType()),
            T.StructField("type", T.StringType()),
            T.StructField("row_id", T.LongType()),
            T.StructField("row", user),
            T.StructField("crc", T.LongType()),
        ]
    )
