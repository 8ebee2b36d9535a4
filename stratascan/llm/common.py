"""Helpers that the text operators share: scratch tables, hot-key joins, distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import remove, scratch_path

#: A key with at least this share of the rows counts as hot, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001

#: Parts into which ranks and prefix sums of one key are dealt.
BUCKETS = 4096

def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables of stage() that nothing reads any more: what was made of them is written, too."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            remove(df.sparkSession, path)


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Joins left (many rows a key) with right (one row a key, `count` rows of left).

    Keys with HOT_SHARE of the `total` rows or more are at most 1 / HOT_SHARE, so that part of
    right is broadcast; all other keys are small, and meet in a shuffle join without skew.
    `left` is read twice: pass a narrow staged table. Rows of left whose key is null go.
    """
    least = max(2, int(total * HOT_SHARE))
    hot = F.broadcast(right.filter(F.col(count) >= least))
    cold = right.filter(F.col(count) < least)
    return left.join(hot, key, "inner").unionByName(
        left.join(F.broadcast(right.filter(F.col(count) >= least).select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(cold, key, how)
    )


def join_counted(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins left, a staged table, with right (one row a key) where any key of left may be hot: counts the keys first."""
    total = left.count()
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= max(1000, int(total * HOT_SHARE))).select(key)
    hot = F.broadcast(stage(hot, "hot"))  # 1 / HOT_SHARE rows at most
    if hot.isEmpty():
        return left.join(right, key, how)
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return left.join(hot, key, "left_semi").join(few, key, how).unionByName(left.join(hot, key, "left_anti").join(right, key, how))


def hot_values(df: DataFrame, column: str, tracked: int = 20_000) -> list:
    """The values of a column that HOT_SHARE of the rows or more have (and maybe some that half as many have): 2 / HOT_SHARE at most.

    A sketch of `tracked` counters a task finds them without a shuffle of the rows; its error is under a tenth of HOT_SHARE.
    """
    found = df.select(F.col(column).alias("v")).agg(F.expr(f"approx_top_k(v, {int(2 / HOT_SHARE)}, {tracked})").alias("t"), F.count(F.lit(1)).alias("n")).first()
    least = max(2, found.n * HOT_SHARE / 2)
    return [x.item for x in found.t or () if x["count"] >= least and x.item is not None]


def prefixed(df: DataFrame, keys: list[str], bucket: Column, order: list[str], amount: str | None, name: str) -> DataFrame:
    """Adds `name`: the sum of `amount` (rows, if None) over the rows before this one within `keys`.

    Rows are in order of `bucket`, a number of some hundred or thousand values, then `order`. Two
    steps, so that no key's rows meet in one task: sums within (key, bucket), then the buckets'
    offsets from their totals.
    """
    b, off, n = f"_{name}_b", f"_{name}_off", f"_{name}_n"
    df = df.withColumn(b, bucket.cast("int")).withColumn(n, F.col(amount).cast("long") if amount else F.lit(1).cast("long"))
    before = lambda by, *sort: Window.partitionBy(*by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, b).agg(F.sum(n).alias("_t"))
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(b).alias("_kb"), F.coalesce(F.sum("_t").over(before(keys, b)), F.lit(0)).alias(off))
    within = df.withColumn("_r", F.coalesce(F.sum(n).over(before([*keys, b], *order)), F.lit(0)))
    on = F.col(b) == F.col("_kb")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return within.join(offsets, on, "inner").withColumn(name, F.col("_r") + F.col(off)).drop(b, off, n, "_r", "_kb", *[f"_k_{k}" for k in keys])


def ranked(df: DataFrame, keys: list[str], ids: list[str], name: str, buckets: int = BUCKETS, salt: int = 0) -> DataFrame:
    """Adds `name`: the row's rank within `keys`, from 0, gapless, in an order that hashes of `ids` fix."""
    h = f"_{name}_h"
    df = df.withColumn(h, F.xxhash64(F.lit(salt), *ids))
    return prefixed(df, keys, F.pmod(h, F.lit(buckets)), [h, *ids], None, name).drop(h)


#: What separates words: space and the characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def columns(df: DataFrame) -> list[Column]:
    """All columns of a frame, whatever characters are in their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
