"""Comparison filters on rows, and the same comparisons on min/max statistics.

`matches` is the exact answer, a filter that Spark pushes into the scan. `might_match` is what
statistics allow to say of a row group or page: false only if no row can match; true where
statistics lack. The two are never mixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ScanError, Status

ROW: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
}

#: Whether bounds rule the comparison out, from (low, high, value).
RULED_OUT: dict[str, Callable[[Column, Column, Column], Column]] = {
    "eq": lambda low, high, v: (v < low) | (v > high),
    "ne": lambda low, high, v: (low == v) & (high == v),
    "lt": lambda low, high, v: low >= v,
    "le": lambda low, high, v: low > v,
    "gt": lambda low, high, v: high <= v,
    "ge": lambda low, high, v: high < v,
}


def _op(op: str, table: dict) -> Callable:
    if op not in table:
        raise ScanError(Status.INVALID_ARGUMENT, f"comparison {op}; known: {', '.join(table)}")
    return table[op]


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def matches(column: Column, op: str, value) -> Column:
    """The row predicate; null where the column is."""
    return _op(op, ROW)(column, _column(value))


def might_match(low: Column, high: Column, op: str, value) -> Column:
    """Whether rows between the bounds may match; true if a bound is unknown."""
    return F.coalesce(~_op(op, RULED_OUT)(low, high, _column(value)), F.lit(True))


def bounds_for(value) -> tuple[str, str]:
    """The footer table's typed bounds that compare with a literal."""
    if isinstance(value, bool | int):
        return "min_long", "max_long"
    if isinstance(value, float):
        return "min_double", "max_double"
    if isinstance(value, str | bytes):
        return "min_bytes", "max_bytes"
    raise ScanError(Status.TYPE_MISMATCH, f"no statistics compare with {type(value).__name__}")


def row_group_matches(chunks: DataFrame, column: str, op: str, value) -> DataFrame:
    """(path, row_group, matches) from footer_columns(), for one column."""
    low, high = bounds_for(value)
    literal = F.lit(bytearray(value.encode() if isinstance(value, str) else value)) if isinstance(value, str | bytes) else F.lit(int(value) if isinstance(value, bool) else value)
    return chunks.filter(F.col("name") == column).select("path", "row_group", might_match(F.col(low), F.col(high), op, literal).alias("matches"))


def filter_row_groups(chunks: DataFrame, column: str, op: str, value, most: int | None = None) -> DataFrame:
    """(path, row_group) that might match, ascending, `most` at most."""
    if most is not None and most <= 0:
        raise ScanError(Status.INVALID_ARGUMENT, "most is not positive")
    out = row_group_matches(chunks, column, op, value).filter("matches").select("path", "row_group").orderBy("path", "row_group")
    return out if most is None else out.limit(most)


def position(low: Column, high: Column, value) -> Column:
    """-1, 0 or 1: the value lies below, within or above the bounds; null if a bound is."""
    v = _column(value)
    return F.when(low.isNull() | high.isNull() | v.isNull(), F.lit(None).cast("int")).when(v < low, -1).when(v > high, 1).otherwise(0)


def overlaps(low: Column, high: Column, start=None, end=None) -> Column:
    """Whether [start, end] meets the bounds; None is unbounded, unknown bounds meet all."""
    out = F.lit(True)
    if end is not None:
        out = out & F.coalesce(_column(end) >= low, F.lit(True))
    if start is not None:
        out = out & F.coalesce(_column(start) <= high, F.lit(True))
    return out


def page_overlaps(null_page: Column, low: Column, high: Column, start=None, end=None) -> Column:
    """The same for a page of a page index: one of nulls alone meets nothing."""
    return ~null_page & overlaps(low, high, start, end)
