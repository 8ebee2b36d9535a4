"""Batch-at-a-time reading of bounded tables: on the driver, or as a frame of batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import ScanError, Status
from ..sources import scan


def iterate(df: DataFrame, batch_size: int = 65536) -> Iterator[pa.RecordBatch]:
    """Batches of batch_size rows, the last one shorter; they come from the executors as Arrow, and partitions one after another, so one of them is on the driver at a time."""
    if batch_size < 1:
        raise ScanError(Status.INVALID_ARGUMENT, "batch_size is below 1")
    schema = to_arrow_schema(df.schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.cast(schema).serialize().to_pybytes()], pa.binary())], ["packed"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for row in df.mapInArrow(pack, "packed binary").toLocalIterator(prefetchPartitions=False):
        held.append(pa.ipc.read_record_batch(pa.py_buffer(bytes(row.packed)), schema))
        rows += held[-1].num_rows
        while rows >= batch_size:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield _one(whole.slice(0, batch_size), schema)
            held, rows = whole.slice(batch_size).to_batches(), rows - batch_size
    if rows:
        yield _one(pa.Table.from_batches(held), schema)


def _one(table: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns], schema=schema)


def batch_summary(df: DataFrame, key: str, batch_size: int = 65536) -> DataFrame:
    """(batch_id, n_rows, first_key, last_key) of the batches that reading a file gives, from the reader's row numbers."""
    batches = scan.with_batches(scan.with_rows(df), batch_size, within=["file_path"])
    return batches.groupBy("file_path", "batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
