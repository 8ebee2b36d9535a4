"""Checking files: magic bytes, footer, and every page against its checksum."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Status, status_of
from . import files


def check_file(uri: str, length: int, read_pages: bool) -> tuple[Status, str]:
    with files.opened(uri) as f:
        return check_open(f, length, read_pages)


def check_open(f, length: int, read_pages: bool) -> tuple[Status, str]:
    """What is wrong with an open file or buffer of so many bytes."""
    import pyarrow.parquet as pq

    try:
        if length < 12:
            return Status.FILE_TRUNCATED, f"{length} bytes"
        if f.read_at(4, 0) != b"PAR1":
            return Status.INVALID_MAGIC, "leading bytes"
        tail = f.read_at(8, length - 8)
        if tail[4:] != b"PAR1":
            return Status.FILE_TRUNCATED, "trailing bytes"
        if int.from_bytes(tail[:4], "little") > length - 12:
            return Status.INVALID_FOOTER, "footer length"
        try:
            file = pq.ParquetFile(f, page_checksum_verification=True)
        except (OSError, ValueError) as error:
            return Status.INVALID_FOOTER, str(error)[:200]
        if read_pages:
            for batch in file.iter_batches():
                del batch
    except Exception as error:  # noqa: BLE001  whatever a damaged file raises is the finding
        return status_of(error), str(error)[:200]
    return Status.OK, ""


def validate(spark: SparkSession, path: str, read_pages: bool = True) -> DataFrame:
    """One row a file: path, length, status, code, message. read_pages: also decode all pages, checking their CRC."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(u, n, *check_file(u, n, read_pages)) for u, n in zip(*(batch.column(k).to_pylist() for k in range(2)))]
            cols = [[r[0] for r in found], [r[1] for r in found], [r[2].name for r in found], [int(r[2]) for r in found], [r[3] for r in found]]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "length", "status", "code", "message"])

    return files.listing(spark, path).mapInArrow(run, "path string, length long, status string, code int, message string")


def validate_buffers(frame: DataFrame, name: str, content: str) -> DataFrame:
    """As validate(), for files that a binary column holds: name, length, status, code, message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, len(raw or b""), *check_open(pa.BufferReader(raw or b""), len(raw or b""), True)) for n, raw in zip(*(batch.column(k).to_pylist() for k in range(2)))]
            cols = [[r[0] for r in found], [r[1] for r in found], [r[2].name for r in found], [int(r[2]) for r in found], [r[3] for r in found]]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["name", "length", "status", "code", "message"])

    return frame.select(F.col(name).cast("string"), F.col(content)).mapInArrow(run, "name string, length long, status string, code int, message string")
