"""Definition and repetition levels: of a schema's nodes, and of a list column's values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def walk(schema: T.StructType) -> Iterator[tuple[str, str, str, int, int, int, bool]]:
    """(path, type, repetition, depth, max_def, max_rep, leaf) of each node in file order, lists and maps in three levels."""

    def visit(path: str, kind: T.DataType, repetition: str, depth: int, d: int, r: int) -> Iterator:
        d += repetition != "REQUIRED"
        r += repetition == "REPEATED"
        name = kind.simpleString() if not isinstance(kind, T.StructType | T.ArrayType | T.MapType) else "group"
        inner = {T.StructType: _struct, T.ArrayType: _array, T.MapType: _map}.get(type(kind))
        yield path, name, repetition, depth, d, r, inner is None
        if inner:
            for step, sub, rep in inner(kind):
                yield from visit(f"{path}.{step}" if path else step, sub, rep, depth + 1, d, r)

    for f in schema.fields:
        yield from visit(f.name, f.dataType, "OPTIONAL" if f.nullable else "REQUIRED", 1, 0, 0)


def _mode(nullable: bool) -> str:
    return "OPTIONAL" if nullable else "REQUIRED"


def _struct(kind: T.StructType):
    return [(f.name, f.dataType, _mode(f.nullable)) for f in kind.fields]


def _array(kind: T.ArrayType):
    return [("list", T.StructType([T.StructField("element", kind.elementType, kind.containsNull)]), "REPEATED")]


def _map(kind: T.MapType):
    pair = T.StructType([T.StructField("key", kind.keyType, False), T.StructField("value", kind.valueType, kind.valueContainsNull)])
    return [("key_value", pair, "REPEATED")]


def schema_levels(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """One row a node, in file order."""
    rows = [(k, *n) for k, n in enumerate(walk(schema))]
    return spark.createDataFrame(rows, "element int, path string, type string, repetition string, depth int, max_def int, max_rep int, is_leaf boolean")


def leaf_index(schema: T.StructType, name: str) -> int:
    """The first leaf whose own name or dotted path is `name`; -1 if none."""
    leaves = [n[0] for n in walk(schema) if n[6]]
    return next((k for k, p in enumerate(leaves) if p == name or p.rpartition(".")[2] == name), -1)


def list_levels(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """One row a level entry of a list column: keys, pos, rep_level, def_level, value.

    As in a three-level list of optional elements: 0 for a null list, 1 for an empty one, 2 for a
    null element, 3 for a value; each list's first entry has repetition 0, the others 1.
    """
    c = F.col(column)
    entries = df.select(*keys, c.isNull().alias("_null"), (F.size(c) == 0).alias("_empty"), F.posexplode_outer(c).alias("_pos", "value"))
    level = F.when(F.col("_null"), 0).when(F.col("_empty"), 1).when(F.col("value").isNull(), 2).otherwise(3)
    pos = F.coalesce(F.col("_pos"), F.lit(0))
    return entries.select(*keys, pos.alias("pos"), F.when(pos > 0, 1).otherwise(0).alias("rep_level"), level.alias("def_level"), "value")


def from_levels(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The list column again: (keys, value array)."""
    kept = F.collect_list(F.when(F.col("def_level") >= 2, F.struct("pos", "value")))
    level = F.max("def_level")
    values = F.transform(F.sort_array(kept), lambda x: x["value"])
    return entries.groupBy(*keys).agg(F.when(level == 0, F.lit(None)).otherwise(values).alias("value"))
