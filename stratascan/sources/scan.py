"""Projected scans: by name or position, with file-relative row numbers, batches and column cursors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ScanError, Status, status_of
from . import arrow_scan, files


# Encodings that Spark's vectorized reader refuses, or (the delta of byte arrays) misreads.
UNSAFE_ENCODINGS = frozenset({"DELTA_BYTE_ARRAY", "BYTE_STREAM_SPLIT"})

#: Footers of so many files are read on the driver, those of more by a Spark job.
FEW_FILES = 8


def open_table(spark: SparkSession, path: str, verify_checksums: bool = True, engine: str = "auto", inspect: str = "all", columns: Sequence[str] | None = None) -> DataFrame:
    """The table at a path.

    engine: spark, arrow, or auto: Spark's reader, but Arrow's where Spark has no type for a column
    or doesn't read an encoding right. inspect: whether auto looks for such encodings in all
    footers, by a Spark job if they are many, or in the first file's alone (for tables of one writer).
    columns: those wanted; Spark finds out by itself what a query reads, Arrow decodes these alone.
    """
    if engine == "arrow":
        return arrow_scan.scan(spark, path, columns, verify_checksums=verify_checksums)
    # The page reader asks the Hadoop configuration; as a read option it goes there for this scan alone.
    reader = spark.read.option("parquet.page.verify-checksum.enabled", str(verify_checksums).lower())
    try:
        df = reader.parquet(path)
    except (PySparkException, Py4JJavaError) as error:
        if engine == "auto" and status_of(error) is Status.TYPE_MISMATCH:
            return arrow_scan.scan(spark, path, columns, verify_checksums=verify_checksums)
        raise ScanError(status_of(error), str(error).splitlines()[0], path=path) from error
    if engine == "auto" and _unsafe(spark, df, path, inspect):
        return arrow_scan.scan(spark, path, columns, verify_checksums=verify_checksums)
    return df if columns is None else project(df, columns)


@contextmanager
def row_reader(spark: SparkSession) -> Iterator[None]:
    """Within it, plans read Parquet row by row: slower than the vectorized reader, but right in every encoding, so that open_table(engine="spark") needs no look at footers."""
    key = "spark.sql.parquet.enableVectorizedReader"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _unsafe(spark: SparkSession, df: DataFrame, path: str, inspect: str) -> bool:
    uris = df.inputFiles()
    if inspect == "first" or len(uris) <= FEW_FILES:
        return any(map(_unsafe_file, uris[:1] if inspect == "first" else uris))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([u for u in batch.column(0).to_pylist() if _unsafe_file(u)], pa.string())], ["path"])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # whatever the files' names
    return not listed.mapInArrow(run, "path string").isEmpty()


def _unsafe_file(uri: str) -> bool:
    import pyarrow.parquet as pq

    try:
        with files.opened(uri) as f:
            meta = pq.ParquetFile(f).metadata
    except (OSError, ValueError):  # a store that only Spark reads, or a damaged file, which the scan will tell of
        return False
    groups = (meta.row_group(k) for k in range(meta.num_row_groups))
    return any(UNSAFE_ENCODINGS.intersection(g.column(c).encodings) for g in groups for c in range(g.num_columns))


def project(df: DataFrame, columns: Sequence[str] | None = None, indices: Sequence[int] | None = None) -> DataFrame:
    """Columns by position, else by name (case counts), else all; order and repeats stay. A bad one is an error now, not later."""
    if indices is not None:
        bad = [k for k in indices if not 0 <= k < len(df.columns)]
        if bad:
            raise ScanError(Status.COLUMN_NOT_FOUND, f"no column at {bad[0]}", column=bad[0])
        return df.select(*[F.col(f"`{df.columns[k]}`") for k in indices])
    if columns is not None:
        for name in columns:
            find_column(df, name)
        return df.select(*[F.col(f"`{name}`") for name in columns])
    return df.select("*")


def find_column(df: DataFrame, name: str) -> int:
    """Position of a column by its exact name, or an error."""
    if name not in df.columns:
        raise ScanError(Status.COLUMN_NOT_FOUND, f"no column named {name}")
    return df.columns.index(name)


def with_rows(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Adds each row's number in its file, which the reader knows, and the file's path; frames of arrow_scan have them by with_rows=True."""
    if {name, "file_path"} <= set(df.columns):
        return df
    return df.select("*", F.col("_metadata.row_index").alias(name), F.col("_metadata.file_path").alias("file_path"))


def with_batches(df: DataFrame, batch_size: int = 65536, row: str = "row_index", within: Sequence[str] = ()) -> DataFrame:
    """Adds batch_id: rows in runs of batch_size by row number, without a shuffle; `within` columns (file, row group) keep batches apart."""
    if batch_size < 1:
        raise ScanError(Status.INVALID_ARGUMENT, "batch_size is below 1")
    return df.withColumn("batch_id", F.call_function("div", F.col(row), F.lit(batch_size))).select(*within, *[c for c in [*df.columns, "batch_id"] if c not in within])


def with_row_groups(rows: DataFrame, groups: DataFrame, row: str = "row_index") -> DataFrame:
    """Adds row_group and the row's position in it, from footer_row_groups() (one row a row group: a small side)."""
    spans = groups.select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), "row_group", F.col("first_row").alias("_first"), (F.col("first_row") + F.col("num_rows")).alias("_end"))
    own = F.regexp_replace("file_path", "^file:/+", "/")
    # Row groups of one file are looked up in an array by file: an equi-join on the path.
    by_file = spans.groupBy("_path").agg(F.sort_array(F.collect_list(F.struct("_first", "_end", "row_group"))).alias("_spans"))
    joined = rows.join(by_file, own == F.col("_path"))
    hit = F.filter("_spans", lambda s: (F.col(row) >= s["_first"]) & (F.col(row) < s["_end"]))[0]
    return joined.select(*rows.columns, hit["row_group"].alias("row_group"), (F.col(row) - hit["_first"]).alias("position"))


def read_column(df: DataFrame, column: str, order: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Values skip .. skip + limit of one column in the order of a key, whatever the rows' order in the file: (order, column). Sorts; by rows' place, see Cursor."""
    find_column(df, column)
    out = df.select(*dict.fromkeys([order, column])).orderBy(order)
    if skip:
        out = out.offset(skip)
    return out if limit is None else out.limit(limit)


def read_rows(df: DataFrame, first: int, end: int, row: str = "row_index") -> DataFrame:
    """Rows first .. end by row number: a filter, so other row groups aren't decoded and nothing is sorted."""
    return df.filter((F.col(row) >= first) & (F.col(row) < end))


class Cursor:
    """A place in a file's rows, of which reading and skipping go on: each read is a frame of the rows by their numbers, without a sort.

    rows is the number of rows there are (of a file, or a row group), as the footer has it; first the
    number of the first of them.
    """

    def __init__(self, df: DataFrame, rows: int, first: int = 0, row: str = "row_index"):
        self.df, self.end, self.at, self.row = df, first + rows, first, row

    def remaining(self) -> int:
        return self.end - self.at

    def has_next(self) -> bool:
        return self.at < self.end

    def skip(self, n: int) -> int:
        """Goes n rows on, or to the end; gives how many it were."""
        if n < 0:
            raise ScanError(Status.INVALID_ARGUMENT, "a cursor goes forwards only")
        n = min(n, self.remaining())
        self.at += n
        return n

    def read(self, n: int) -> DataFrame:
        """The next n rows, or all that remain."""
        first = self.at
        self.skip(n)
        return read_rows(self.df, first, self.at, self.row)


def read_buffers(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Tables held in whole files' bytes: each file comes as one binary value and is decoded where it is."""
    import pyarrow as pa

    def run(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            for content in batch.column(0):
                for found in pq.ParquetFile(pa.BufferReader(content.as_buffer())).iter_batches():
                    yield found

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ddl)
