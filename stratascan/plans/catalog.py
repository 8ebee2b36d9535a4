"""The named queries: each an operator applied to whole tables, with the same result in SQL where SQL can say it.

A query's SQL reads the tables by name; footer queries look for the file that a table's view reads.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import version_info
from ..functions import bloom, encodings, hashing, names
from ..operators import levels, pruning, stats
from ..scratch import scratch_path
from ..sources import checks, footers, page_index, scan, sink
from ..streaming import batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Where the driver keeps the tables, in a folder a scale.
TABLES = "/root/testdata/sf*"


def footer_sql(function: str, name: str) -> str:
    """A table function of DuckDB over the footer of the very file that the table's view reads: of all scales, the one with as many rows."""
    glob = f"'{TABLES}/{name}.parquet'"
    return f"(SELECT * FROM {function}({glob}) WHERE file_name = (SELECT min(file_name) FROM parquet_file_metadata({glob}) WHERE num_rows = (SELECT count(*) FROM {name})))"


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan.open_table(spark, f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table that a query writes and reads back."""
    return scratch_path(spark, f"{name}.parquet")


# ---- scans and projections


@query("SELECT * FROM orders")
def scan_all(spark, sf_dir):
    return scan.project(table(spark, sf_dir, "orders"))


@query("SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem")
def scan_project_names(spark, sf_dir):
    return scan.project(table(spark, sf_dir, "lineitem"), columns=["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"])


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders")
def scan_project_index(spark, sf_dir):
    return scan.project(table(spark, sf_dir, "orders"), indices=[5, 0, 3])


@query("SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 45")
def scan_filter_project(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").filter(pruning.matches(F.col("l_quantity"), "gt", 45.0))
    return scan.project(found, columns=["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"])


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_buffer(spark, sf_dir):
    return scan.read_buffers(spark, f"{sf_dir}/supplier.parquet", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_arrow(spark, sf_dir):
    return scan.open_table(spark, f"{sf_dir}/customer.parquet", engine="arrow")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events")
def scan_row_index(spark, sf_dir):
    return scan.with_rows(table(spark, sf_dir, "events").select("event_id")).drop("file_path")


@query("SELECT event_id // 1024 AS batch_id, count(*) AS n_rows, min(event_id) AS first_key, max(event_id) AS last_key FROM events GROUP BY 1")
def batch_summary(spark, sf_dir):
    return batches.batch_summary(table(spark, sf_dir, "events"), "event_id", batch_size=1024).drop("file_path")


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 700 OFFSET 5000")
def column_read_skip(spark, sf_dir):
    cursor = _events_cursor(spark, sf_dir)
    cursor.skip(5000)
    return cursor.read(700).select("event_id", "value")


def _events_cursor(spark, sf_dir):
    rows = footers.footer_files(spark, f"{sf_dir}/events.parquet").agg(F.sum("num_rows")).first()[0]
    return scan.Cursor(scan.with_rows(table(spark, sf_dir, "events").select("event_id", "value")), rows)


@query("SELECT * FROM (SELECT step, CAST(greatest(0, (SELECT count(*) FROM events) - gone) AS BIGINT) AS remaining, (SELECT count(*) FROM events) > gone AS has_next FROM (VALUES (0, 0), (1, 5000), (2, 5700), (3, 100000000)) AS t(step, gone))")
def cursor_remaining(spark, sf_dir):
    cursor, rows = _events_cursor(spark, sf_dir), []
    for step, n in enumerate((0, 5000, 700, 100_000_000)):
        cursor.skip(n)
        rows.append((step, cursor.remaining(), cursor.has_next()))
    return spark.createDataFrame(rows, "step int, remaining long, has_next boolean")


@query("SELECT event_id, event_type FROM events WHERE event_id >= 2000 AND event_id < 4500")
def read_row_range(spark, sf_dir):
    return scan.read_rows(scan.with_rows(table(spark, sf_dir, "events").select("event_id", "event_type")), 2000, 4500).select("event_id", "event_type")


@query("SELECT CAST(0 AS INTEGER) AS row_group, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) - 1 AS last_position FROM orders")
def rows_by_row_group(spark, sf_dir):
    path = f"{sf_dir}/orders.parquet"
    rows = scan.with_row_groups(scan.with_rows(table(spark, sf_dir, "orders").select("o_orderkey")), footers.footer_row_groups(spark, path))
    groups = rows.groupBy("file_path", "row_group")  # each file has a row group 0
    return groups.agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.max("position").alias("last_position")).drop("file_path")


@query("SELECT count(*) AS n_rows FROM lineitem")
def metadata_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS sum_id, CAST(sum(user_id) AS BIGINT) AS sum_user, round(sum(value), 2) AS sum_value FROM events")
def benchmark_shape(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("sum_id"), F.sum("user_id").alias("sum_user"), F.round(F.sum("value"), 2).alias("sum_value"))


# ---- row filters

_SIGNS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def _filters() -> None:
    for op, sign in _SIGNS.items():

        def run(spark, sf_dir, op=op):
            return table(spark, sf_dir, "orders").filter(pruning.matches(F.col("o_custkey"), op, 700)).select("o_orderkey", "o_custkey")

        query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey {sign} 700", f"filter_{op}")(run)


_filters()


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag <= 'N'")
def filter_string_bytes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter(pruning.matches(F.col("l_returnflag"), "le", "N")).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01 00:00:00'")
def filter_timestamp(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(pruning.matches(F.col("o_orderdate"), "ge", F.expr("TIMESTAMP_NTZ '1999-06-01 00:00:00'"))).select("o_orderkey", "o_orderdate")


# ---- statistics of logical row groups, and pruning by them


def _groups(spark, sf_dir, column="value"):
    events = table(spark, sf_dir, "events").withColumn("rg", F.call_function("div", F.col("event_id"), F.lit(1000)))
    return stats.column_statistics(events, column, ["rg"])


_GROUPS_SQL = "SELECT event_id // 1000 AS rg, count(*) AS num_values, count(*) FILTER ({c} IS NULL) AS null_count, min({c}) AS min_value, max({c}) AS max_value, count({c}) > 0 AS has_min_max, count(DISTINCT {c}) AS distinct_count FROM events GROUP BY 1"


@query(_GROUPS_SQL.format(c="value"))
def column_statistics(spark, sf_dir):
    return _groups(spark, sf_dir)


@query(_GROUPS_SQL.format(c="props"))
def column_statistics_strings(spark, sf_dir):
    return _groups(spark, sf_dir, "props")


@query("SELECT count(*) AS num_values, count(*) FILTER (user_id IS NULL) AS null_count, min(user_id) AS min_value, max(user_id) AS max_value, count(user_id) > 0 AS has_min_max, CAST(NULL AS BIGINT) AS distinct_count FROM events")
def merge_statistics(spark, sf_dir):
    return stats.merge(_groups(spark, sf_dir, "user_id"))


_RULED_OUT_SQL = {"eq": "{v} < lo OR {v} > hi", "ne": "lo = {v} AND hi = {v}", "lt": "lo >= {v}", "le": "lo > {v}", "gt": "hi <= {v}", "ge": "hi < {v}"}


def _matchers() -> None:
    for op, ruled_out in _RULED_OUT_SQL.items():

        def run(spark, sf_dir, op=op):
            g = _groups(spark, sf_dir, "event_id")
            return g.select("rg", pruning.might_match(F.col("min_value"), F.col("max_value"), op, 4999).alias("matches"))

        query(f"WITH g AS (SELECT event_id // 1000 AS rg, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1) SELECT rg, NOT ({ruled_out.format(v=4999)}) AS matches FROM g", f"row_group_matches_{op}")(run)


_matchers()


@query("WITH g AS (SELECT event_id // 1000 AS rg, max(event_id) AS hi FROM events GROUP BY 1) SELECT rg FROM g WHERE hi >= 3500 ORDER BY rg LIMIT 4")
def filter_row_groups(spark, sf_dir):
    g = _groups(spark, sf_dir, "event_id")
    return g.filter(pruning.might_match(F.col("min_value"), F.col("max_value"), "ge", 3500)).select("rg").orderBy("rg").limit(4)


@query("WITH g AS (SELECT event_id // 1000 AS rg, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1) SELECT rg, CASE WHEN 4321 < lo THEN -1 WHEN 4321 > hi THEN 1 ELSE 0 END AS position FROM g")
def stat_compare(spark, sf_dir):
    return _groups(spark, sf_dir, "event_id").select("rg", pruning.position(F.col("min_value"), F.col("max_value"), 4321).alias("position"))


@query("WITH g AS (SELECT event_id // 1000 AS rg, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1) SELECT rg, 5200 >= lo AND 2900 <= hi AS inside, 2900 <= hi AS from_2900, 5200 >= lo AS to_5200 FROM g")
def range_overlap(spark, sf_dir):
    lo, hi = F.col("min_value"), F.col("max_value")
    return _groups(spark, sf_dir, "event_id").select("rg", pruning.overlaps(lo, hi, 2900, 5200).alias("inside"), pruning.overlaps(lo, hi, start=2900).alias("from_2900"), pruning.overlaps(lo, hi, end=5200).alias("to_5200"))


_PAGES_SQL = "(SELECT rg, k // 100 AS page, min(k) AS first_row, count(*) AS n_rows, count({c}) = 0 AS null_page, count(*) FILTER ({c} IS NULL) AS null_count, min({c}) AS min_value, max({c}) AS max_value FROM (SELECT event_id // 1000 AS rg, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS k, * FROM events) GROUP BY 1, 2)"


@query(f"SELECT * FROM {_PAGES_SQL.format(c='value')}")
def page_statistics(spark, sf_dir):
    return stats.column_index(_chunks(spark, sf_dir), "value", "event_id", ["rg"], 100)


@query(f"SELECT rg, page FROM {_PAGES_SQL.format(c='value')} WHERE NOT null_page AND NOT (max_value < 900 OR min_value > 905)")
def page_range_match(spark, sf_dir):
    pages = stats.column_index(_chunks(spark, sf_dir), "value", "event_id", ["rg"], 100)
    return pages.filter(pruning.page_overlaps(F.col("null_page"), F.col("min_value"), F.col("max_value"), 900.0, 905.0)).select("rg", "page")


_ORDER_SQL = "(SELECT rg, CASE WHEN bool_and(coalesce(min_value >= a AND max_value >= b, true)) THEN 'ASCENDING' WHEN bool_and(coalesce(min_value <= a AND max_value <= b, true)) THEN 'DESCENDING' ELSE 'UNORDERED' END AS boundary_order FROM (SELECT *, lag(min_value) OVER w AS a, lag(max_value) OVER w AS b FROM {p} WINDOW w AS (PARTITION BY rg ORDER BY page)) GROUP BY rg)"


@query(f"SELECT 'value' AS name, * FROM {_ORDER_SQL.format(p=_PAGES_SQL.format(c='value'))} UNION ALL SELECT 'event_id' AS name, * FROM {_ORDER_SQL.format(p=_PAGES_SQL.format(c='event_id'))}")
def page_boundary_order(spark, sf_dir):
    orders = [stats.boundary_order(stats.column_index(_chunks(spark, sf_dir), c, "event_id", ["rg"], 100), ["rg"]).select(F.lit(c).alias("name"), "rg", "boundary_order") for c in ("value", "event_id")]
    return orders[0].unionByName(orders[1])


# ---- footers


@query(f"SELECT num_rows, CAST(num_row_groups AS INTEGER) AS num_row_groups, created_by, CAST(file_size_bytes AS BIGINT) AS file_size, CAST(footer_size AS BIGINT) AS footer_size FROM {footer_sql('parquet_file_metadata', 'orders')}")
def footer_file_info(spark, sf_dir):
    return footers.footer_files(spark, f"{sf_dir}/orders.parquet").select("num_rows", "num_row_groups", "created_by", "file_size", "footer_size")


@query(f"SELECT CAST(row_group_id AS INTEGER) AS row_group, row_group_num_rows AS num_rows, CAST(row_group_num_columns AS INTEGER) AS num_columns, row_group_bytes AS total_byte_size, CAST(sum(total_compressed_size) AS BIGINT) AS compressed_size FROM {footer_sql('parquet_metadata', 'lineitem')} GROUP BY ALL")
def footer_row_groups(spark, sf_dir):
    return footers.footer_row_groups(spark, f"{sf_dir}/lineitem.parquet").select("row_group", "num_rows", "num_columns", "total_byte_size", "compressed_size")


@query(f"SELECT CAST(row_group_id AS INTEGER) AS row_group, CAST(column_id AS INTEGER) AS \"column\", path_in_schema AS name, type AS physical_type, compression AS codec, num_values, total_compressed_size AS compressed_size, total_uncompressed_size AS uncompressed_size, data_page_offset AS data_offset, stats_null_count AS null_count FROM {footer_sql('parquet_metadata', 'lineitem')}")
def footer_columns(spark, sf_dir):
    chunks = footers.footer_columns(spark, f"{sf_dir}/lineitem.parquet")
    return chunks.select("row_group", "column", "name", "physical_type", "codec", "num_values", "compressed_size", "uncompressed_size", "data_offset", "null_count")


@query(f"SELECT path_in_schema AS name, CAST(stats_min_value AS BIGINT) AS min_long, CAST(stats_max_value AS BIGINT) AS max_long FROM {footer_sql('parquet_metadata', 'orders')} WHERE path_in_schema IN ('o_orderkey', 'o_custkey')")
def footer_statistics(spark, sf_dir):
    chunks = footers.footer_columns(spark, f"{sf_dir}/orders.parquet")
    return chunks.filter(F.col("name").isin("o_orderkey", "o_custkey")).select("name", "min_long", "max_long")


@query(f"SELECT name, type AS physical_type, CASE WHEN column_id > 0 THEN repetition_type END AS repetition, CAST(coalesce(num_children, 0) AS INTEGER) AS num_children, CAST(column_id AS INTEGER) AS element, type IS NOT NULL AS is_leaf FROM {footer_sql('parquet_schema', 'embeddings')}")
def footer_schema(spark, sf_dir):
    return footers.schema_elements(spark, f"{sf_dir}/embeddings.parquet").select("name", "physical_type", "repetition", "num_children", "element", "is_leaf")


@query(f"SELECT CAST(row_group_id AS INTEGER) AS row_group, NOT (CAST(stats_max_value AS BIGINT) < 1200) AS matches FROM {footer_sql('parquet_metadata', 'orders')} WHERE path_in_schema = 'o_custkey'")
def footer_row_group_matches(spark, sf_dir):
    chunks = footers.footer_columns(spark, f"{sf_dir}/orders.parquet")
    return pruning.row_group_matches(chunks, "o_custkey", "ge", 1200).select("row_group", "matches")


@query(f"SELECT path_in_schema AS name, false AS can_zero_copy FROM {footer_sql('parquet_metadata', 'orders')}")
def footer_zero_copy(spark, sf_dir):
    return footers.footer_columns(spark, f"{sf_dir}/orders.parquet").select("name", "can_zero_copy")


@query(f"SELECT decode(key) AS key, octet_length(value) AS value_bytes FROM {footer_sql('parquet_kv_metadata', 'orders')}")
def footer_key_values(spark, sf_dir):
    return footers.key_values(spark, f"{sf_dir}/orders.parquet").select("key", F.octet_length("value").cast("long").alias("value_bytes"))


@query(f"SELECT 'OK' AS status, 0 AS code, CAST(file_size_bytes AS BIGINT) AS length FROM {footer_sql('parquet_file_metadata', 'orders')}")
def validate_files(spark, sf_dir):
    return checks.validate(spark, f"{sf_dir}/orders.parquet").select("status", "code", "length")


@query("SELECT status, code, files FROM (VALUES ('CRC_MISMATCH', 71, CAST(1 AS BIGINT)), ('OK', 0, CAST(1 AS BIGINT)), ('INVALID_MAGIC', 20, CAST(1 AS BIGINT))) AS t(status, code, files)")
def validate_damaged(spark, sf_dir):
    """A table as it is, with a byte of each file's first page changed, and with other leading bytes: pages are held against their CRC. Counts the tables with files so."""
    path = scratch(spark, "checked")
    sink.write(table(spark, sf_dir, "supplier"), path, sink.WriterOptions(dictionary=False))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("content")

    def three(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                chunk = pq.ParquetFile(pa.BufferReader(raw)).metadata.row_group(0).column(0)
                place = chunk.data_page_offset + chunk.total_compressed_size - 4
                changed = raw[:place] + bytes([raw[place] ^ 1]) + raw[place + 1 :]
                for name, data in (("as-is", raw), ("changed", changed), ("other", b"XXXX" + raw[4:])):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], ["name", "content"])

    return checks.validate_buffers(content.mapInArrow(three, "name string, content binary"), "name", "content").groupBy("status", "code").agg(F.countDistinct("name").alias("files"))


@query("SELECT 'event_id' AS \"column\", count(*) AS rows, CAST(0 AS BIGINT) AS nulls, min(event_id) AS low, max(event_id) AS high, 'ASCENDING' AS boundary_order, count(*) > 4000 AS many_pages FROM events")
def page_index_pages(spark, sf_dir):
    """Pages of files in order of a key: their bounds are the files', and each begins where the one before ended."""
    path = scratch(spark, "paged")
    sink.write(table(spark, sf_dir, "events").select("event_id").repartitionByRange("event_id").sortWithinPartitions("event_id"), path, sink.WriterOptions(page_size=8192, dictionary=False))
    pages = page_index.page_index(spark, path)
    low, high = (hashing.from_little_endian(F.col(c)) for c in ("min_bytes", "max_bytes"))
    rows = footers.footer_files(spark, path).agg(F.sum("num_rows")).first()[0]
    pages = pages.withColumn("start", F.min(low).over(Window.partitionBy("path", "row_group")))
    found = pages.filter((F.col("start") + F.col("first_row") == low) & ~F.col("null_page"))  # keys have no gaps here, so a page's first key is its row group's and the rows since
    return found.groupBy("column", "boundary_order").agg(F.lit(rows).alias("rows"), F.sum("null_count").alias("nulls"), F.min(low).alias("low"), F.max(high).alias("high"), (F.count(F.lit(1)) > 1).alias("many_pages"))


# ---- sinks


def _roundtrips() -> None:
    for codec in ("none", "snappy", "gzip", "lz4_raw", "zstd"):

        def run(spark, sf_dir, codec=codec):
            path = scratch(spark, codec)
            sink.write(table(spark, sf_dir, "orders"), path, sink.WriterOptions(compression=codec))
            return scan.open_table(spark, path)

        query("SELECT * FROM orders", f"roundtrip_{codec}")(run)


_roundtrips()


_WRITTEN = {"none": "UNCOMPRESSED", "snappy": "SNAPPY", "gzip": "GZIP", "lz4": "LZ4", "lz4_raw": "LZ4_RAW", "zstd": "ZSTD"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS asked, '{w}' AS codec, count(*) AS num_rows, CAST(sum(s_suppkey) AS BIGINT) AS key_sum, {str(c != 'none').lower()} AS smaller FROM supplier" for c, w in _WRITTEN.items()))
def written_codecs(spark, sf_dir):
    """The codec that the footer of each written table has, what it reads back, and whether its chunks are smaller than their contents."""
    out = []
    for codec in _WRITTEN:
        path = scratch(spark, f"codec_{codec}")
        sink.write(table(spark, sf_dir, "supplier"), path, sink.WriterOptions(compression=codec))
        chunks = footers.footer_columns(spark, path).agg(F.lit(codec).alias("asked"), F.max("codec").alias("codec"), (F.sum("compressed_size") < F.sum("uncompressed_size")).alias("smaller"))
        back = scan.open_table(spark, path, engine="arrow" if codec == "lz4" else "auto").agg(F.count(F.lit(1)).alias("num_rows"), F.sum("s_suppkey").alias("key_sum"))
        out.append(chunks.crossJoin(F.broadcast(back)))  # one row each
    return reduce(DataFrame.unionByName, out).select("asked", "codec", "num_rows", "key_sum", "smaller")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS o_totalprice FROM orders")
def roundtrip_nullable(spark, sf_dir):
    path = scratch(spark, "nullable")
    sparse = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    sink.write(sparse, path, sink.WriterOptions(compression="zstd", compression_level=9))
    return scan.open_table(spark, path)


@query("SELECT event_id, user_id, event_type, value FROM events")
def roundtrip_delta_encodings(spark, sf_dir):
    path = scratch(spark, "delta")
    sink.write(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path, sink.WriterOptions(version_2=True, dictionary=False))
    return scan.open_table(spark, path)


@query("SELECT count(*) AS num_rows, true AS several, true AS gapless FROM lineitem")
def roundtrip_row_groups(spark, sf_dir):
    path = scratch(spark, "groups")
    sink.write(table(spark, sf_dir, "lineitem"), path, sink.WriterOptions(row_group_size=256 << 10, page_size=16 << 10))
    ends = F.max(F.col("first_row") + F.col("num_rows")) == F.sum("num_rows")
    apart = F.countDistinct("row_group") == F.count(F.lit(1))
    by_file = footers.footer_row_groups(spark, path).groupBy("path").agg(F.sum("num_rows").alias("num_rows"), F.count(F.lit(1)).alias("groups"), apart.alias("apart"), ends.alias("gapless"))
    several = F.coalesce(F.bool_or(F.col("groups") > 1) & F.bool_and("apart"), F.lit(False))  # the last file may be small
    return by_file.agg(F.sum("num_rows").alias("num_rows"), several.alias("several"), F.bool_and("gapless").alias("gapless"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 1234 OR l_orderkey = 7")
def roundtrip_bloom(spark, sf_dir):
    path = scratch(spark, "bloom")
    sink.write(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), path, sink.WriterOptions(compression="snappy", bloom={"l_orderkey": 20000}))
    return scan.open_table(spark, path).filter(F.col("l_orderkey").isin(1234, 7))


# ---- nulls and levels

_SPARSE_SQL = "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v, CASE WHEN event_id % 4 <> 0 THEN event_type END AS t FROM events"


def _sparse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("t"))


@query(f"SELECT event_id, v IS NULL AS v_is_null, t IS NULL AS t_is_null FROM ({_SPARSE_SQL})")
def null_bitmap(spark, sf_dir):
    return _sparse(spark, sf_dir).select("event_id", stats.is_null(F.col("v")).alias("v_is_null"), stats.is_null(F.col("t")).alias("t_is_null"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS n_null, count({c}) AS n_value FROM ({_SPARSE_SQL})" for c in ("event_id", "v", "t")))
def null_counts(spark, sf_dir):
    return stats.null_counts(_sparse(spark, sf_dir))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN i > 1 THEN 1 ELSE 0 END AS rep_level, 3 AS def_level, embedding[i] AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def levels_list(spark, sf_dir):
    return levels.list_levels(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])


@query("SELECT vec_id, len(embedding) AS n, embedding[1] AS first, embedding[len(embedding)] AS last FROM embeddings")
def levels_assembled(spark, sf_dir):
    lists = levels.from_levels(levels.list_levels(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"]), ["vec_id"])
    return lists.select("vec_id", F.size("value").cast("long").alias("n"), F.col("value")[0].alias("first"), F.element_at("value", -1).alias("last"))


@query("SELECT * FROM (VALUES (0, 'vec_id', 1, 0, true), (1, 'embedding', 1, 0, false), (2, 'embedding.list', 2, 1, false), (3, 'embedding.list.element', 3, 1, true), (4, 'label', 1, 0, true)) AS t(element, path, max_def, max_rep, is_leaf)")
def schema_levels(spark, sf_dir):
    return levels.schema_levels(spark, table(spark, sf_dir, "embeddings").schema).select("element", "path", "max_def", "max_rep", "is_leaf")


# ---- encodings, by chunks of 1,000 events


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("rg", F.call_function("div", F.col("event_id"), F.lit(1000)))


_CHUNKS_SQL = "(SELECT *, event_id // 1000 AS rg FROM events)"


@query(f"WITH f AS (SELECT rg, event_type, min(event_id) AS p FROM {_CHUNKS_SQL} GROUP BY 1, 2), d AS (SELECT rg, event_type, CAST(row_number() OVER (PARTITION BY rg ORDER BY p) - 1 AS INTEGER) AS i FROM f) SELECT c.rg, event_id, i AS \"index\" FROM {_CHUNKS_SQL} c JOIN d ON c.rg = d.rg AND c.event_type = d.event_type")
def dictionary_encode(spark, sf_dir):
    return encodings.dictionary_encode(_chunks(spark, sf_dir), "event_type", "event_id", ["rg"])


@query("SELECT event_id // 1000 AS rg, event_id, event_type FROM events")
def dictionary_decode(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    coded = encodings.dictionary_encode(chunks, "event_type", "event_id", ["rg"])
    return encodings.dictionary_decode(coded, encodings.dictionary(chunks, "event_type", "event_id", ["rg"]), "event_type", "event_id", ["rg"])


@query(f"WITH a AS (SELECT rg, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM {_CHUNKS_SQL} WINDOW w AS (PARTITION BY rg ORDER BY event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY rg ORDER BY event_id) - 1 AS run FROM a) SELECT rg, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, min(event_id) AS first_pos, count(*) AS length, CASE WHEN count(*) >= 8 THEN 'RLE' ELSE 'BIT_PACKED' END AS kind FROM b GROUP BY rg, run")
def rle_runs(spark, sf_dir):
    return encodings.runs(_chunks(spark, sf_dir), "event_type", "event_id", ["rg"]).withColumn("kind", encodings.hybrid_kind(F.col("length")))


@query("SELECT event_id // 1000 AS rg, event_id % 1000 AS pos, event_type FROM events")
def rle_expand(spark, sf_dir):
    return encodings.expand_runs(encodings.runs(_chunks(spark, sf_dir), "event_type", "event_id", ["rg"]), "event_type", ["rg"])


@query(f"SELECT rg, event_id, user_id - coalesce(lag(user_id) OVER (PARTITION BY rg ORDER BY event_id), 0) AS delta FROM {_CHUNKS_SQL}")
def delta_encode(spark, sf_dir):
    return encodings.delta_encode(_chunks(spark, sf_dir), "user_id", "event_id", ["rg"])


@query("SELECT event_id // 1000 AS rg, event_id, user_id FROM events")
def delta_decode(spark, sf_dir):
    return encodings.delta_decode(encodings.delta_encode(_chunks(spark, sf_dir), "user_id", "event_id", ["rg"]), "user_id", "event_id", ["rg"])


@query(f"WITH e AS (SELECT rg, row_number() OVER w - 2 AS k, user_id - lag(user_id) OVER w AS d FROM {_CHUNKS_SQL} WINDOW w AS (PARTITION BY rg ORDER BY event_id)) SELECT rg, k // 128 AS block, count(*) AS n, min(d) AS min_delta, CAST(CASE WHEN max(d) = min(d) THEN 0 ELSE length(ltrim(bin(max(d) - min(d)), '0')) END AS INTEGER) AS bit_width FROM e WHERE k >= 0 GROUP BY 1, 2")
def delta_blocks(spark, sf_dir):
    return encodings.delta_blocks(encodings.delta_encode(_chunks(spark, sf_dir), "user_id", "event_id", ["rg"]), "event_id", ["rg"])


@query("SELECT event_id // 1000 AS rg, event_id, CAST(strlen(props) AS INTEGER) AS byte_length FROM events")
def delta_length(spark, sf_dir):
    return encodings.delta_lengths(_chunks(spark, sf_dir), "props", "event_id", ["rg"])


_DOCS_SQL = "(SELECT doc_id // 1000 AS rg, doc_id, text FROM documents WHERE text IS NOT NULL)"


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.call_function("div", F.col("doc_id"), F.lit(1000)).alias("rg"), "doc_id", "text")


@query(f"WITH p AS (SELECT rg, doc_id, hex(encode(text)) AS v, coalesce(hex(encode(lag(text) OVER (PARTITION BY rg ORDER BY doc_id))), '') AS b FROM {_DOCS_SQL}), n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(length(v), length(b)) // 2 + 1), lambda k: v[2 * k - 1 : 2 * k] <> b[2 * k - 1 : 2 * k])) - 1, least(length(v), length(b)) // 2) AS n FROM p) SELECT rg, doc_id, CAST(n AS INTEGER) AS prefix_length, v[2 * n + 1 :] AS suffix FROM n")
def prefix_suffix(spark, sf_dir):
    """Prefixes are counted in bytes: texts have letters of two."""
    return encodings.prefix_encode(_texts(spark, sf_dir), "text", "doc_id", ["rg"]).withColumn("suffix", F.hex("suffix"))


@query(f"SELECT rg, row_number() OVER (PARTITION BY rg ORDER BY doc_id) - 1 AS pos, text AS value FROM {_DOCS_SQL}")
def prefix_decode(spark, sf_dir):
    return encodings.prefix_decode(encodings.prefix_encode(_texts(spark, sf_dir), "text", "doc_id", ["rg"]), "doc_id", ["rg"]).withColumn("value", F.col("value").cast("string"))


@query(f"SELECT rg, row_number() OVER (PARTITION BY rg ORDER BY doc_id) - 1 AS pos, text AS value FROM {_DOCS_SQL}")
def delta_length_decode(spark, sf_dir):
    return encodings.delta_length_decode(encodings.delta_length_encode(_texts(spark, sf_dir), "text", "doc_id", ["rg"]), ["rg"]).withColumn("value", F.col("value").cast("string"))


@query("SELECT event_id, CASE WHEN event_id - 5000 >= 0 THEN 2 * (event_id - 5000) ELSE -2 * (event_id - 5000) - 1 END AS zigzag, event_id - 5000 AS back FROM events")
def zigzag(spark, sf_dir):
    coded = table(spark, sf_dir, "events").select("event_id", encodings.zigzag(F.col("event_id") - 5000).alias("zigzag"))
    return coded.withColumn("back", encodings.unzigzag(F.col("zigzag")))


@query("SELECT event_id, CAST(CASE WHEN event_id < 128 THEN 1 WHEN event_id < 16384 THEN 2 ELSE 3 END AS INTEGER) AS n_bytes, event_id AS back FROM events")
def varint(spark, sf_dir):
    coded = table(spark, sf_dir, "events").select("event_id", encodings.varint(F.col("event_id")).alias("bytes"))
    return coded.select("event_id", F.octet_length("bytes").alias("n_bytes"), encodings.unvarint(F.col("bytes")).alias("back"))


@query("SELECT event_id, " + " || ".join(f"printf('%02X', (event_id >> {8 * k}) & 255)" for k in range(8)) + " AS bytes FROM events")
def little_endian(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.hex(hashing.little_endian(F.col("event_id"), "bigint")).alias("bytes"))


@query("SELECT event_id // 1000 AS rg, event_id % 1000 AS pos, event_id % 500 AS value FROM events")
def bit_pack_unpack(spark, sf_dir):
    coded = encodings.bit_pack(_chunks(spark, sf_dir).withColumn("small", F.col("event_id") % 500), "small", "event_id", ["rg"], 9)
    return encodings.bit_unpack(coded, ["rg"], 9)


@query("SELECT event_id // 1000 AS rg, event_id % 1000 AS pos, value FROM events")
def byte_stream_split(spark, sf_dir):
    streams = encodings.byte_stream_split(_chunks(spark, sf_dir), "value", "event_id", ["rg"])
    return encodings.byte_stream_join(streams, ["rg"])


# ---- hashes and bloom filters


@query()
def crc32_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", hashing.crc32(F.col("props")).alias("crc32"))


@query()
def xxh64_key(spark, sf_dir):
    return hashing.with_xxh64(table(spark, sf_dir, "events").select("event_id"), "event_id")


# Published vectors, and values of other implementations of the two hashes.
_VECTORS = {"": (0, 0xEF46DB3751D8E999), "a": (0xE8B7BE43, 0xD24EC4F1A98C6E5B), "123456789": (0xCBF43926, 0x8CB841DB40E6AE83), "abc": (0x352441C2, 0x44BC2CF5AD770999)}


@query(" UNION ALL ".join(f"SELECT '{k}' AS key, CAST({c} AS BIGINT) AS crc32, '{h:016X}' AS xxh64" for k, (c, h) in _VECTORS.items()))
def hash_vectors(spark, sf_dir):
    keys = spark.createDataFrame([(k,) for k in _VECTORS], "key string")
    return hashing.with_xxh64(keys, "key").select("key", hashing.crc32(F.col("key")).alias("crc32"), F.lpad(F.hex("xxh64"), 16, "0").alias("xxh64"))


def _orders_bloom(spark, sf_dir, fpp=0.01):
    """The keys, and the blocks of a filter for all of them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders, bloom.blocks_for(max(1, orders.count()), fpp)  # the count is from footers


@query("SELECT o_orderkey, true AS might_contain, CAST(NULL AS BOOLEAN) AS of_null FROM orders")
def bloom_membership(spark, sf_dir):
    orders, blocks = _orders_bloom(spark, sf_dir)
    built = bloom.build(orders, "o_orderkey", blocks)
    found = bloom.check(orders, "o_orderkey", built, blocks)
    return bloom.check(found.withColumn("none", F.lit(None).cast("long")), "none", built, blocks, "of_null").drop("none")


@query("SELECT true AS below_limit, count(*) AS absent, true AS some_rejected FROM orders")
def bloom_false_positives(spark, sf_dir):
    orders, blocks = _orders_bloom(spark, sf_dir)
    absent = orders.select((-1 - F.col("o_orderkey")).alias("o_orderkey"))  # as many keys, none of them in the table
    found = bloom.check(absent, "o_orderkey", bloom.build(orders, "o_orderkey", blocks), blocks)
    return found.agg((F.avg(F.col("might_contain").cast("int")) < 0.03).alias("below_limit"), F.count(F.lit(1)).alias("absent"), F.bool_or(~F.col("might_contain")).alias("some_rejected"))


@query("SELECT CAST((count(*) + 31) // 32 * 32 AS BIGINT) AS bytes, count(*) AS all_found, true AS same_as_whole FROM orders")
def bloom_by_bytes(spark, sf_dir):
    """A filter of as many bytes as the table has keys, in whole blocks; halves merged are the whole."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    blocks = bloom.blocks_in(orders.count())
    whole = bloom.build(orders, "o_orderkey", blocks)
    merged = bloom.merge(*(bloom.build(orders.filter(F.col("o_orderkey") % 2 == k), "o_orderkey", blocks) for k in range(2)))
    apart = whole.select("block", "word", "bits").exceptAll(merged.select("block", "word", "bits")).agg((F.count(F.lit(1)) == 0).alias("same_as_whole"))
    found = bloom.check(orders, "o_orderkey", merged, blocks).agg(F.count_if("might_contain").alias("all_found"))
    return found.crossJoin(F.broadcast(apart)).withColumn("bytes", F.lit(32 * blocks).cast("long"))  # one row each


@query("SELECT o_orderkey, true AS might_contain FROM orders")
def bloom_merge(spark, sf_dir):
    orders, blocks = _orders_bloom(spark, sf_dir)
    parts = [bloom.build(orders.filter(F.col("o_orderkey") % 2 == k), "o_orderkey", blocks) for k in range(2)]
    return bloom.check(orders, "o_orderkey", bloom.merge(*parts), blocks)


@query("SELECT * FROM (VALUES ('stratascan', true), ('pyspark', true), ('pyarrow', true), ('python', true), ('processor', true)) AS t(name, known)")
def versions(spark, sf_dir):
    return spark.createDataFrame([(k, bool(v)) for k, v in version_info().items()], "name string, known boolean")


@query("SELECT * FROM (VALUES (0, 'UNCOMPRESSED', 'PLAIN', 'BOOLEAN'), (1, 'SNAPPY', 'UNKNOWN', 'INT32'), (5, 'LZ4', 'DELTA_BINARY_PACKED', 'DOUBLE'), (7, 'LZ4_RAW', 'DELTA_BYTE_ARRAY', 'FIXED_LEN_BYTE_ARRAY'), (9, 'UNKNOWN', 'BYTE_STREAM_SPLIT', 'UNKNOWN')) AS t(number, codec, encoding, physical_type)")
def format_names(spark, sf_dir):
    numbers = spark.createDataFrame([(k,) for k in (0, 1, 5, 7, 9)], "number int")
    return numbers.select("number", names.named(F.col("number"), names.CODECS).alias("codec"), names.named(F.col("number"), names.ENCODINGS).alias("encoding"), names.named(F.col("number"), names.PHYSICAL_TYPES).alias("physical_type"))
