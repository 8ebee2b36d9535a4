"""Page indexes of files, decoded where their files are dealt; and bloom filters of a file, through the reader library in Spark's JVM.

Executors read the footers and the bytes of the indexes only, so many files are a Spark job like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import ScanError, Status
from . import files, thrift

SCHEMA = "path string, row_group int, column string, page int, first_row long, null_page boolean, null_count long, min_bytes binary, max_bytes binary, boundary_order string, page_offset long, compressed_size int"

# The numbers of boundary orders.
ORDERS = ("UNORDERED", "ASCENDING", "DESCENDING")


def available(spark: SparkSession) -> bool:
    """Whether the JVM has the reader."""
    try:
        return spark._jvm.java.lang.Class.forName("org.apache.parquet.hadoop.ParquetFileReader") is not None
    except Exception:  # noqa: BLE001  any failure of the bridge means no
        return False


def _pages(f, length: int, columns: list[str] | None) -> Iterator[tuple]:
    """A tuple a page, as in SCHEMA after the path. Field numbers are those of the format's FileMetaData, ColumnChunk, ColumnIndex and OffsetIndex."""
    for g, group in enumerate(thrift.footer(f, length).get(4, [])):
        for chunk in group[1]:
            name = ".".join(x.decode("utf-8", "replace") for x in chunk[3][3])
            if columns is not None and name not in columns or not {4, 5, 6, 7} <= chunk.keys():
                continue
            offsets = thrift.decode(f.read_at(chunk[5], chunk[4]))[1]
            index = thrift.decode(f.read_at(chunk[7], chunk[6]))
            for p, (place, empty, low, high) in enumerate(zip(offsets, index[1], index[2], index[3])):
                nulls = index[5][p] if index.get(5) else None
                yield g, name, p, place[3], empty, nulls, None if empty else low, None if empty else high, ORDERS[index[4]], place[1], place[2]


def page_index(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """One row a page of the files at a path: its rows, nulls, bounds (plain-encoded bytes) and place."""
    shape = to_arrow_schema(T.StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, length in zip(*(batch.column(k).to_pylist() for k in range(2))):
                with files.opened(uri) as f:
                    found = [(uri, *r) for r in _pages(f, length, columns)]
                yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in found], schema=shape)

    return files.listing(spark, path).mapInArrow(run, SCHEMA)


def bloom_contains(spark: SparkSession, path: str, column: str, hashes: list[int]) -> dict[int, list[bool]]:
    """For each row group of a file with a bloom filter on the column: whether it may hold each hash (XXH64, signed)."""
    if not available(spark):
        raise ScanError(Status.NOT_IMPLEMENTED, "the JVM has no Parquet reader")
    jvm = spark._jvm
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), spark._jsparkSession.sessionState().newHadoopConf())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    out: dict[int, list[bool]] = {}
    try:
        for g, block in enumerate(reader.getFooter().getBlocks()):
            for chunk in block.getColumns():
                if chunk.getPath().toDotString() == column and (bloom := reader.readBloomFilter(chunk)) is not None:
                    jlong = jvm.java.lang.Long
                    out[g] = [bool(bloom.findHash(jlong.valueOf(str(int(np.int64(h)))).longValue())) if abs(h) < 1 << 31 else bool(bloom.findHash(h)) for h in hashes]
    finally:
        reader.close()
    return out
