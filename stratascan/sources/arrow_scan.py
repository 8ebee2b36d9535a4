"""Scan through Arrow for what Spark's reader refuses: UUID, 16-bit floats, nanoseconds, times, wide decimals, split byte streams.

The unit of work is a row group: footers give (file, row group) pairs, which are dealt out, and each
task decodes its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ScanError, Status
from . import files


def target(kind: pa.DataType) -> tuple[pa.DataType, str]:
    """The Arrow type and Spark type that stand for an Arrow type."""
    t = pa.types
    if t.is_float16(kind):
        return pa.float32(), "float"
    if str(kind) == "extension<arrow.uuid>":
        return pa.string(), "string"
    if t.is_timestamp(kind):
        if kind.unit == "ns":
            return pa.int64(), "bigint"  # nanoseconds since the epoch
        return pa.timestamp("us", kind.tz and "UTC"), "timestamp" if kind.tz else "timestamp_ntz"
    if t.is_time(kind):
        return pa.int64(), "bigint"  # of the type's own unit since midnight
    if t.is_decimal(kind):
        return (pa.string(), "string") if kind.precision > 38 else (pa.decimal128(kind.precision, kind.scale), f"decimal({kind.precision},{kind.scale})")
    if t.is_dictionary(kind):
        return target(kind.value_type)
    if t.is_fixed_size_binary(kind) or t.is_large_binary(kind):
        return pa.binary(), "binary"
    if t.is_large_string(kind):
        return pa.string(), "string"
    if t.is_null(kind):
        return pa.int32(), "int"
    plain = {pa.bool_(): "boolean", pa.int8(): "tinyint", pa.int16(): "smallint", pa.int32(): "int", pa.int64(): "bigint", pa.float32(): "float", pa.float64(): "double", pa.string(): "string", pa.binary(): "binary", pa.date32(): "date"}
    if kind in plain:
        return kind, plain[kind]
    wider = {pa.uint8(): (pa.int16(), "smallint"), pa.uint16(): (pa.int32(), "int"), pa.uint32(): (pa.int64(), "bigint"), pa.uint64(): (pa.decimal128(20, 0), "decimal(20,0)")}
    if kind in wider:
        return wider[kind]
    if t.is_list(kind):
        inner, name = target(kind.value_type)
        return pa.list_(inner), f"array<{name}>"
    raise ScanError(Status.NOT_IMPLEMENTED, f"no Spark type for {kind}")


def converted(column: pa.Array, to: pa.DataType) -> pa.Array:
    if column.type == to:
        return column
    if str(column.type) == "extension<arrow.uuid>":
        return pa.array([None if v is None else str(v) for v in column.to_pylist()], pa.string())
    if pa.types.is_decimal(column.type) and pa.types.is_string(to):
        return pa.array([None if v is None else format(v, "f") for v in column.to_pylist()], pa.string())
    if pa.types.is_time(column.type):
        return column.cast(pa.int32() if pa.types.is_time32(column.type) else pa.int64()).cast(to)
    if pa.types.is_dictionary(column.type):
        return converted(column.dictionary_decode(), to)
    return pc.cast(column, to)


def table_schema(spark: SparkSession, path: str) -> pa.Schema:
    """The columns of all files at a path, by the first that has them; files differ in schema seldom, so distinct ones alone come to the driver."""

    def schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            found = {}
            for uri in batch.column(0).to_pylist():
                with files.opened(uri) as f:
                    found.setdefault(pq.ParquetFile(f).schema_arrow.remove_metadata().serialize().to_pybytes(), uri)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.string())], ["schema", "path"])

    rows = files.listing(spark, path).select("path").mapInArrow(schemas, "schema binary, path string").groupBy("schema").agg(F.min("path").alias("path")).collect()
    if not rows:
        raise ScanError(Status.FILE_NOT_FOUND, "no Parquet file", path=path)
    fields: dict[str, pa.Field] = {}
    for r in sorted(rows, key=lambda r: r.path):
        for field in pa.ipc.read_schema(pa.py_buffer(bytes(r.schema))):
            known = fields.setdefault(field.name, field)
            if target(known.type) != target(field.type):
                raise ScanError(Status.TYPE_MISMATCH, f"column {field.name} is {known.type} in one file and {field.type} in another", path=r.path)
    return pa.schema(fields.values())


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, verify_checksums: bool = True, with_rows: bool = False) -> DataFrame:
    """The table at a path, or some of its columns; a column that a file lacks is null there. with_rows: also row_index, in the file, and file_path."""
    schema = table_schema(spark, path)
    names = list(columns) if columns is not None else schema.names
    for n in names:
        if n not in schema.names:
            raise ScanError(Status.COLUMN_NOT_FOUND, f"no column named {n}", path=path)
    types = {n: target(schema.field(n).type) for n in names}
    placed = ["row_index", "file_path"] if with_rows else []

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with files.opened(uri) as f:
                    meta = pq.ParquetFile(f).metadata
                sizes = [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]
                first = [0, *itertools.accumulate(sizes)][:-1]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(sizes), pa.string()), pa.array(range(len(sizes)), pa.int32()), pa.array(first, pa.int64())], ["path", "row_group", "first_row"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for uri, k, row in zip(*(batch.column(c).to_pylist() for c in range(3))):
                with files.opened(uri) as f:
                    file = pq.ParquetFile(f, page_checksum_verification=verify_checksums)
                    there = [n for n in names if n in file.schema_arrow.names]
                    for found in file.iter_batches(row_groups=[k], columns=there):
                        own = [converted(found.column(n), types[n][0]) if n in there else pa.nulls(found.num_rows, types[n][0]) for n in names]
                        if with_rows:
                            own += [pa.array(range(row, row + found.num_rows), pa.int64()), pa.array([uri] * found.num_rows, pa.string())]
                        row += found.num_rows
                        yield pa.RecordBatch.from_arrays(own, [*names, *placed])

    pairs = files.listing(spark, path).select("path").mapInArrow(groups, "path string, row_group int, first_row long")
    dealt = pairs.repartition(F.col("path"), F.col("row_group"))  # some bytes a row group
    kinds = [*(f"`{n}` {types[n][1]}" for n in names), *(["row_index long", "file_path string"] if with_rows else [])]
    return dealt.mapInArrow(decode, ", ".join(kinds))
