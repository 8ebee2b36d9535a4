"""Finding files with Spark, reading byte ranges of them on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the Parquet files at a path: Spark lists them, and reads no contents, as content isn't selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not path.rstrip("/").endswith((".parquet", ".parq", ".pq")) or _is_directory(spark, path):
        reader = reader.option("pathGlobFilter", "*.{parquet,parq,pq}")
    return reader.load(path).select("path", "length")


def _is_directory(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def opened(uri: str):
    """An Arrow random-access file for a URI, from an executor: only the ranges asked for are read."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        from urllib.parse import unquote

        return fs.LocalFileSystem().open_input_file(unquote(uri.removeprefix("file://").removeprefix("file:")) if uri.startswith("file:") else uri)
    system, inner = fs.FileSystem.from_uri(uri)
    return system.open_input_file(inner)
