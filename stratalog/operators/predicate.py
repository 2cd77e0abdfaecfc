"""The six comparison predicates, three-way comparison and zone-map skipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PredicateOp

_PYTHON = {T.IntegerType: int, T.LongType: int, T.DoubleType: (int, float), T.StringType: str}


def typed_literal(dtype: T.DataType, value) -> Column:
    """A literal of exactly the column's type: comparison never goes through double."""
    if value is None:
        return F.lit(None).cast(dtype)
    kind = _PYTHON.get(type(dtype))
    if kind is None or isinstance(value, bool) or not isinstance(value, kind):
        raise TypeError(f"a {type(value).__name__} literal cannot be compared with {dtype.simpleString()}")
    if isinstance(dtype, T.IntegerType) and not -(2**31) <= value < 2**31:
        dtype = T.LongType()
    return F.lit(float(value) if isinstance(dtype, T.DoubleType) else value).cast(dtype)


def compare(column: Column, op: PredicateOp, literal: Column) -> Column:
    return {
        PredicateOp.EQ: lambda: column == literal,
        PredicateOp.NE: lambda: column != literal,
        PredicateOp.LT: lambda: column < literal,
        PredicateOp.LE: lambda: column <= literal,
        PredicateOp.GT: lambda: column > literal,
        PredicateOp.GE: lambda: column >= literal,
    }[op]()


def where_op(df: DataFrame, column: str, op: PredicateOp, value) -> DataFrame:
    """Rows for which ``column op value`` is true. NULL on either side matches nothing."""
    return df.where(compare(F.col(column), op, typed_literal(df.schema[column].dataType, value)))


def three_way(left: Column, right: Column) -> Column:
    """-1, 0 or 1; NULL if either side is NULL."""
    return F.when(left < right, -1).when(left > right, 1).when(left == right, 0)


def can_skip(op: PredicateOp, low: Column, high: Column, literal: Column) -> Column:
    """True if no row of a segment whose values lie in [low, high] can match.

    Without statistics (NULL bounds) nothing is skipped.
    """
    rule = {
        PredicateOp.EQ: (literal < low) | (literal > high),
        PredicateOp.NE: F.lit(False),
        PredicateOp.LT: literal <= low,
        PredicateOp.LE: literal < low,
        PredicateOp.GT: literal >= high,
        PredicateOp.GE: literal > high,
    }[op]
    return F.coalesce(rule, F.lit(False))
