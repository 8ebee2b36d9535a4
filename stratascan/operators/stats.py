"""Column statistics by group: bounds, nulls, values, distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_statistics(df: DataFrame, column: str, by: Sequence[str] = (), distinct: str | None = "exact") -> DataFrame:
    """One row a group: num_values (nulls included), null_count, min_value, max_value, has_min_max, distinct_count.

    Bounds follow the type's order, NaN last, strings by bytes, whatever their length. distinct:
    exact, approximate, or None for null.
    """
    c = F.col(column)
    count = {"exact": F.count_distinct(c), "approximate": F.approx_count_distinct(c), None: F.lit(None).cast("long")}[distinct]
    aggregates = [
        F.count(F.lit(1)).alias("num_values"),
        F.count_if(c.isNull()).alias("null_count"),
        F.min(c).alias("min_value"),
        F.max(c).alias("max_value"),
        (F.count(c) > 0).alias("has_min_max"),
        count.alias("distinct_count"),
    ]
    return df.groupBy(*by).agg(*aggregates)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row a column: name, nulls, values. One pass over the table; the columns are unpivoted after it."""
    names = list(columns or df.columns)
    one = df.agg(*[F.struct(F.count_if(F.col(f"`{c}`").isNull()).alias("n_null"), F.count(F.col(f"`{c}`")).alias("n_value")).alias(f"c{k}") for k, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"c{k}.n_null").alias("n_null"), F.col(f"c{k}.n_value").alias("n_value")) for k, c in enumerate(names)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def merge(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Statistics of parts put together (distinct values can't be, and are null)."""
    return parts.groupBy(*by).agg(
        F.sum("num_values").alias("num_values"), F.sum("null_count").alias("null_count"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.bool_or("has_min_max").alias("has_min_max"), F.lit(None).cast("long").alias("distinct_count"),
    )


def is_null(column: Column) -> Column:
    """The null bitmap as a named boolean."""
    return column.isNull()


def column_index(df: DataFrame, column: str, order: str, within: Sequence[str], page_rows: int) -> DataFrame:
    """A page index as a relation: (within, page, first_row, n_rows, null_page, null_count, min_value, max_value) for pages of page_rows rows."""
    w = Window.partitionBy(*within).orderBy(order)
    placed = df.select(*within, F.col(column).alias("_v"), (F.row_number().over(w) - 1).alias("_k")).withColumn("page", F.call_function("div", F.col("_k"), F.lit(page_rows)))
    out = placed.groupBy(*within, "page").agg(
        F.min("_k").cast("long").alias("first_row"), F.count(F.lit(1)).alias("n_rows"), (F.count("_v") == 0).alias("null_page"), F.count_if(F.col("_v").isNull()).alias("null_count"), F.min("_v").alias("min_value"), F.max("_v").alias("max_value")
    )
    return out


def boundary_order(pages: DataFrame, within: Sequence[str]) -> DataFrame:
    """(within, boundary_order) of a page index: ASCENDING or DESCENDING if the bounds of pages with values are, ascending if both; else UNORDERED."""
    w = Window.partitionBy(*within).orderBy("page")
    low, high = F.lag("min_value").over(w), F.lag("max_value").over(w)
    steps = pages.filter(~F.col("null_page")).select(
        *within, (F.coalesce(F.col("min_value") >= low, F.lit(True)) & F.coalesce(F.col("max_value") >= high, F.lit(True))).alias("_up"), (F.coalesce(F.col("min_value") <= low, F.lit(True)) & F.coalesce(F.col("max_value") <= high, F.lit(True))).alias("_down")
    )
    kind = F.when(F.bool_and("_up"), "ASCENDING").when(F.bool_and("_down"), "DESCENDING").otherwise("UNORDERED")
    return steps.groupBy(*within).agg(kind.alias("boundary_order"))


def int96_order(column: Column) -> Column:
    """What INT96 values (12 bytes: nanoseconds of the day, then the Julian day) are compared by: the day first, as a struct that orders so."""
    number = lambda first, last: F.conv(F.array_join(F.transform(F.sequence(F.lit(last), F.lit(first), F.lit(-1)), lambda k: F.hex(F.substring(column, k, F.lit(1)))), ""), 16, 10).cast("long")
    return F.when(F.octet_length(column) == 12, F.struct(number(9, 12).alias("day"), number(1, 8).alias("nanos")))
