"""Footer tables: files, row groups, column chunks, schema elements and key-value metadata as frames.

Spark lists the files; each executor task decodes the footers of its files and gives rows. Nothing
but footers is read, and nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.names import CODECS
from . import files, thrift

# Physical types of one fixed width, in bytes.
FIXED_WIDTH = {"INT32": 4, "INT64": 8, "INT96": 12, "FLOAT": 4, "DOUBLE": 8}

FILE_SCHEMA = "path string, file_size long, num_rows long, num_row_groups int, num_columns int, format_version string, created_by string, footer_size long"
ROW_GROUP_SCHEMA = "path string, row_group int, num_rows long, num_columns int, total_byte_size long, compressed_size long, first_row long"
CHUNK_SCHEMA = (
    "path string, row_group int, column int, name string, physical_type string, logical_type string, max_def int, max_rep int, codec string, encodings array<string>, num_values long, "
    "has_min_max boolean, null_count long, distinct_count long, min_value string, max_value string, min_long long, max_long long, min_double double, max_double double, min_bytes binary, max_bytes binary, "
    "compressed_size long, uncompressed_size long, dictionary_offset long, data_offset long, can_zero_copy boolean"
)
ELEMENT_SCHEMA = "path string, element int, parent int, column int, name string, full_name string, is_leaf boolean, repetition string, num_children int, physical_type string, logical_type string, converted_type string, type_length int, field_id int, max_def int, max_rep int"
# The numbers of repetitions.
REPETITIONS = ("REQUIRED", "OPTIONAL", "REPEATED")
KEY_VALUE_SCHEMA = "path string, key string, value binary"


def _table(spark: SparkSession, path: str, schema: str, rows: Callable) -> DataFrame:
    shape = to_arrow_schema(T.StructType.fromDDL(schema))
    names = shape.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for uri, length in zip(*(batch.column(k).to_pylist() for k in range(2))):
                with files.opened(uri) as f:
                    meta = pq.ParquetFile(f).metadata
                    found = [(uri, *r) for r in rows(meta, length, f)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in found], schema=shape)

    return files.listing(spark, path).mapInArrow(run, schema)


def footer_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: size, rows, row groups, columns, version, writer."""
    return _table(spark, path, FILE_SCHEMA, lambda m, length, _f: [(length, m.num_rows, m.num_row_groups, m.num_columns, m.format_version, m.created_by, m.serialized_size)])


def footer_row_groups(spark: SparkSession, path: str) -> DataFrame:
    """One row a row group; compressed_size is the chunks' sum, first_row the rows before it in the file."""

    def rows(m, _length, _f):
        first = 0
        for k in range(m.num_row_groups):
            g = m.row_group(k)
            yield k, g.num_rows, g.num_columns, g.total_byte_size, sum(g.column(c).total_compressed_size for c in range(g.num_columns)), first
            first += g.num_rows

    return _table(spark, path, ROW_GROUP_SCHEMA, rows)


def footer_columns(spark: SparkSession, path: str) -> DataFrame:
    """One row a column chunk: types, levels, codec, encodings, statistics, sizes and offsets.

    has_min_max needs both bounds. Bounds come as text, and as long, double or bytes by physical
    type. can_zero_copy: stored as it lies in memory, so neither compressed, nor with levels, nor of
    variable width.
    """

    def rows(m, length, f):
        told = None
        for k in range(m.num_row_groups):
            g = m.row_group(k)
            for c in range(g.num_columns):
                x, leaf = g.column(c), m.schema.column(c)
                s = x.statistics if x.is_stats_set else None
                known = bool(s and s.has_min_max)
                low, high = (s.min_raw, s.max_raw) if known else (None, None)
                whole = x.physical_type in ("INT32", "INT64", "BOOLEAN")
                real = x.physical_type in ("FLOAT", "DOUBLE")
                text = lambda v: None if v is None else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
                raw = lambda v: None if v is None else v.encode() if isinstance(v, str) else bytes(v)
                codec = x.compression
                if codec == "LZ4" or codec not in CODECS.values():  # Arrow names both LZ4 framings alike, or not at all; field 4 of ColumnMetaData has the number
                    told = told or thrift.footer(f, length)
                    codec = CODECS.get(told[4][k][1][c][3][4], "UNKNOWN")
                plain = set(x.encodings) <= {"PLAIN", "RLE", "BIT_PACKED"}
                yield (
                    k, c, x.path_in_schema, x.physical_type, str(leaf.logical_type), leaf.max_definition_level, leaf.max_repetition_level, codec, list(x.encodings), x.num_values,
                    known, s.null_count if s and s.has_null_count else None, s.distinct_count if s and s.has_distinct_count else None, text(s.min if known else None), text(s.max if known else None),
                    int(low) if known and whole else None, int(high) if known and whole else None, float(low) if known and real else None, float(high) if known and real else None,
                    raw(low) if known and not whole and not real else None, raw(high) if known and not whole and not real else None,
                    x.total_compressed_size, x.total_uncompressed_size, x.dictionary_page_offset if x.has_dictionary_page else None, x.data_page_offset,
                    x.compression == "UNCOMPRESSED" and leaf.max_definition_level == 0 and (x.physical_type in FIXED_WIDTH or x.physical_type == "FIXED_LEN_BYTE_ARRAY") and plain,
                )

    return _table(spark, path, CHUNK_SCHEMA, rows)


def schema_elements(spark: SparkSession, path: str) -> DataFrame:
    """One row an element of the schema, groups and leaves, in the footer's order, the root first: its place in the tree, repetition, types and levels.

    full_name is the path of names from below the root; column numbers the leaves. Types are those of leaves; for a group
    they are null.
    """
    shape = to_arrow_schema(T.StructType.fromDDL(ELEMENT_SCHEMA))

    def elements(f, length: int, meta) -> Iterator[tuple]:
        # Field numbers are those of the format's SchemaElement.
        raw, leaves, open_groups = thrift.footer(f, length)[2], 0, []  # open groups: (element, children to come, names, max_def, max_rep)
        for k, e in enumerate(raw):
            while open_groups and not open_groups[-1][1]:
                open_groups.pop()
            parent, _, names, max_def, max_rep = open_groups[-1] if open_groups else (None, 0, [], 0, 0)
            if open_groups:
                open_groups[-1][1] -= 1
            name, repetition = e[4].decode("utf-8", "replace"), REPETITIONS[e.get(3, 0)]
            if parent is not None:
                names, max_def, max_rep = [*names, name], max_def + (repetition != "REQUIRED"), max_rep + (repetition == "REPEATED")
            leaf = meta.schema.column(leaves) if not e.get(5) and k else None
            yield (
                k, parent, leaves if leaf else None, name, ".".join(names), leaf is not None, repetition if k else None, e.get(5, 0), leaf.physical_type if leaf else None,
                str(leaf.logical_type) if leaf else None, str(leaf.converted_type) if leaf else None, e.get(2) if leaf and leaf.physical_type == "FIXED_LEN_BYTE_ARRAY" else None, e.get(9), max_def, max_rep,
            )
            if leaf:
                leaves += 1
            else:
                open_groups.append([k, e.get(5, 0), names, max_def, max_rep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for uri, length in zip(*(batch.column(k).to_pylist() for k in range(2))):
                with files.opened(uri) as f:
                    found = [(uri, *r) for r in elements(f, length, pq.ParquetFile(f).metadata)]
                yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in found], schema=shape)

    return files.listing(spark, path).mapInArrow(run, ELEMENT_SCHEMA)


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """One row a key of the file's metadata."""
    return _table(spark, path, KEY_VALUE_SCHEMA, lambda m, _length, _f: [(k.decode("utf-8", "replace"), v) for k, v in (m.metadata or {}).items()])
