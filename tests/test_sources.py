"""Scans, footers, sinks, checks: across engines, over damaged files, over types that Spark lacks."""

import datetime as dt
import decimal
import random
import uuid

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stratascan.errors import RECOVERABLE, ScanError, Status, status_of
from stratascan.functions import hashing
from stratascan.operators import pruning
from stratascan.sources import arrow_scan, checks, footers, page_index, scan, sink
from stratascan.streaming import batches

CODECS = ["none", "snappy", "gzip", "lz4_raw", "zstd"]
WORDS = ["alpha", "beta", "", "gamma ray", "δέλτα", "epsilon", "zeta", "eta", "theta", "iota"]


def mixed_rows(n):
    """Flags, whole numbers, reals, strings with every seventh null, and numbers with every fifth null."""
    return [(i % 2 == 0, 10 * i - 5000, 1_000_000 * i - 2_500_000_000, 0.5 * i - 1250, 0.125 * i - 312.5, None if i % 7 == 0 else WORDS[i % 10], None if i % 5 == 0 else 100 * i) for i in range(n)]


MIXED = "flag boolean, small int, large long, real float, wide double, name string, sparse int"


@pytest.mark.parametrize("codec", CODECS)
def test_other_engines_read_what_is_written(spark, tmp_path, codec):
    rows = mixed_rows(5000)
    sink.write(spark.createDataFrame(rows, MIXED).coalesce(1), f"{tmp_path}/t.parquet", sink.WriterOptions(compression=codec))
    got = pq.read_table(f"{tmp_path}/t.parquet").to_pylist()
    assert [tuple(r.values()) for r in got] == rows
    n, null_names, null_sparse, true, total, last = duckdb.sql(f"SELECT count(*), count(*) FILTER (name IS NULL), count(*) FILTER (sparse IS NULL), count(*) FILTER (flag), sum(small), max(small) FROM '{tmp_path}/t.parquet/*.parquet'").fetchall()[0]
    assert (n, null_names, null_sparse, true, total, last) == (5000, 715, 1000, 2500, 99_975_000, 44_990)
    want = {"none": "UNCOMPRESSED", "lz4_raw": "LZ4_RAW"}.get(codec, codec.upper())
    names = {r[0] for r in duckdb.sql(f"SELECT DISTINCT compression FROM parquet_metadata('{tmp_path}/t.parquet/*.parquet')").fetchall()}
    assert names == {want}


@pytest.mark.parametrize("codec", ["none", "snappy", "gzip", "lz4", "zstd"])
def test_reads_what_other_engines_write(spark, tmp_path, codec):
    rows = mixed_rows(700)
    columns = list(zip(*rows))
    names = [c.strip().split()[0] for c in MIXED.split(",")]
    table = pa.table({n: pa.array(c) if n != "real" else pa.array(c, pa.float32()) for n, c in zip(names, columns)})
    pq.write_table(table, f"{tmp_path}/a.parquet", compression=codec, row_group_size=100, store_decimal_as_integer=False)
    for engine in ("spark", "arrow"):
        got = scan.open_table(spark, f"{tmp_path}/a.parquet", engine=engine).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
    duckdb.execute(f"COPY (SELECT range AS id, CASE WHEN range % 3 <> 0 THEN range END AS n, 'v' || range AS s FROM range(1000)) TO '{tmp_path}/d.parquet' (FORMAT parquet, CODEC '{ {'none': 'uncompressed', 'lz4': 'lz4_raw'}.get(codec, codec)}')")
    d = scan.open_table(spark, f"{tmp_path}/d.parquet")
    assert d.agg(F.count("id"), F.count("n"), F.max("s")).first() == (1000, 666, "v999")


@pytest.mark.parametrize("encoding", ["PLAIN", "DELTA_BINARY_PACKED", "DELTA_LENGTH_BYTE_ARRAY", "DELTA_BYTE_ARRAY", "BYTE_STREAM_SPLIT", "RLE_DICTIONARY"])
def test_every_encoding_is_read_right(spark, tmp_path, encoding):
    n = 3000
    table = pa.table({"i": pa.array(range(n), pa.int64()), "s": [f"key{k // 7:05d}/{k}" for k in range(n)], "d": [k * 0.25 for k in range(n)]})
    fits = {"DELTA_BINARY_PACKED": ["i"], "DELTA_LENGTH_BYTE_ARRAY": ["s"], "DELTA_BYTE_ARRAY": ["s"], "BYTE_STREAM_SPLIT": ["d"]}.get(encoding, [])
    pq.write_table(table, f"{tmp_path}/e.parquet", use_dictionary=encoding == "RLE_DICTIONARY", column_encoding={c: encoding for c in fits} or None, data_page_size=4096)
    for inspect in ("first", "all"):
        got = scan.open_table(spark, f"{tmp_path}/e.parquet", inspect=inspect).orderBy("i").collect()
        assert [tuple(r) for r in got] == [tuple(r.values()) for r in table.to_pylist()]


@pytest.mark.parametrize("n_files", [2, 12])
def test_encodings_of_later_files_count(spark, tmp_path, n_files):
    strings = [f"key{k // 7:05d}/{k}" for k in range(3000)]
    (tmp_path / "documents.parquet").mkdir()
    for k in range(n_files):
        table = pa.table({"i": pa.array(range(3000), pa.int64()), "s": strings})
        last = k == n_files - 1
        pq.write_table(table, f"{tmp_path}/documents.parquet/part-{k:02d}.parquet", use_dictionary=False, column_encoding={"s": "DELTA_BYTE_ARRAY"} if last else None, data_page_size=4096)
    assert sorted(r.s for r in scan.open_table(spark, f"{tmp_path}/documents.parquet").collect()) == sorted(strings * n_files)


def test_types_that_spark_lacks(spark, tmp_path):
    ids = [uuid.UUID(int=k * 7919) for k in range(3)]
    table = pa.table(
        {
            "u": pa.ExtensionArray.from_storage(pa.uuid(), pa.array([x.bytes for x in ids], pa.binary(16))),
            "h": pa.array(np.array([0.5, -2, 3], np.float16)),
            "ns": pa.array([1, None, 3], pa.timestamp("ns")),
            "ms": pa.array([dt.time(0, 0, 1), dt.time(1), None], pa.time32("ms")),
            "wide": pa.array([decimal.Decimal("1." + "0" * 9 + "5"), None, decimal.Decimal(7)], pa.decimal256(60, 10)),
            "u64": pa.array([2**64 - 1, 0, None], pa.uint64()),
            "l": pa.array([[1], [], None], pa.list_(pa.int32())),
        }
    )
    pq.write_table(table, f"{tmp_path}/g.parquet", version="2.6")
    got = [tuple(r) for r in scan.open_table(spark, f"{tmp_path}/g.parquet").collect()]
    assert [r[0] for r in got] == list(map(str, ids))
    assert [r[1:] for r in got] == [(0.5, 1, 1000, "1.0000000005", decimal.Decimal(2**64 - 1), [1]), (-2.0, None, 3_600_000, None, decimal.Decimal(0), []), (3.0, 3, None, "7.0000000000", None, None)]
    with pytest.raises(ScanError) as e:
        arrow_scan.scan(spark, f"{tmp_path}/g.parquet", columns=["none"])
    assert e.value.status is Status.COLUMN_NOT_FOUND


def test_edge_tables(spark, tmp_path):
    pq.write_table(pa.table({"a": pa.array([], pa.int32()), "b": pa.array([], pa.string())}), f"{tmp_path}/empty.parquet")
    empty = scan.open_table(spark, f"{tmp_path}/empty.parquet")
    assert (empty.columns, empty.count()) == (["a", "b"], 0)
    assert footers.footer_files(spark, f"{tmp_path}/empty.parquet").first().num_rows == 0
    pq.write_table(pa.table({"n": pa.array([None] * 100, pa.int32()), "v": range(100)}), f"{tmp_path}/nulls.parquet")
    chunk = footers.footer_columns(spark, f"{tmp_path}/nulls.parquet").filter("name = 'n'").first()
    assert (chunk.has_min_max, chunk.null_count, chunk.num_values) == (False, 100, 100)
    assert pruning.row_group_matches(footers.footer_columns(spark, f"{tmp_path}/nulls.parquet"), "n", "eq", 5).first().matches
    wide = pa.table({f"col_{k:04d}": pa.array(range(20), pa.int32()) for k in range(1600)})
    pq.write_table(wide, f"{tmp_path}/wide.parquet")
    assert scan.project(scan.open_table(spark, f"{tmp_path}/wide.parquet"), indices=[1599, 0, 1599]).columns == ["col_1599", "col_0000", "col_1599"]
    assert footers.schema_elements(spark, f"{tmp_path}/wide.parquet").filter("is_leaf").count() == 1600


def test_projection_errors(spark):
    df = spark.createDataFrame([(1, 2)], "a int, B int")
    assert scan.find_column(df, "B") == 1
    for bad in ({"columns": ["b"]}, {"columns": ["none"]}, {"indices": [2]}, {"indices": [-1]}):
        with pytest.raises(ScanError) as e:
            scan.project(df, **bad)
        assert e.value.status is Status.COLUMN_NOT_FOUND and e.value.hint
    assert scan.project(df, columns=["a"], indices=[1]).columns == ["B"]  # positions win
    with pytest.raises(ScanError):
        scan.with_batches(df, 0)


def many_groups(path, n=5000, group=500):
    rng = np.random.default_rng(1)
    pq.write_table(pa.table({"id": pa.array(range(n), pa.int64()), "x": rng.random(n), "s": [f"k{k:06d}" for k in range(n)]}), path, row_group_size=group, compression="none", use_dictionary=False, write_page_index=True, data_page_size=500, write_batch_size=50, write_page_checksum=True)


@pytest.mark.parametrize(("op", "value", "want"), [("eq", 1234, [2]), ("eq", -1, []), ("lt", 500, [0]), ("lt", 0, []), ("le", 500, [0, 1]), ("gt", 4499, [9]), ("gt", 4998, [9]), ("ge", 5000, []), ("ge", 4000, [8, 9]), ("ne", 7, list(range(10)))])
def test_row_group_pruning(spark, tmp_path, op, value, want):
    many_groups(f"{tmp_path}/r.parquet")
    chunks = footers.footer_columns(spark, f"{tmp_path}/r.parquet")
    assert [r.row_group for r in pruning.filter_row_groups(chunks, "id", op, value).collect()] == want
    text = [r.row_group for r in pruning.filter_row_groups(chunks, "s", op, f"k{value:06d}" if value >= 0 else "a").collect()]
    assert text == want
    # What pruning keeps holds all rows that match.
    rows = scan.with_row_groups(scan.with_rows(scan.open_table(spark, f"{tmp_path}/r.parquet")), footers.footer_row_groups(spark, f"{tmp_path}/r.parquet"))
    hit = rows.filter(pruning.matches(F.col("id"), op, value)).select("row_group").distinct()
    assert {r.row_group for r in hit.collect()} <= set(want)
    assert len(pruning.filter_row_groups(chunks, "id", op, value, most=1).collect()) == min(1, len(want))


def test_pruning_arguments(spark, tmp_path):
    many_groups(f"{tmp_path}/r.parquet", 1000)
    chunks = footers.footer_columns(spark, f"{tmp_path}/r.parquet")
    for bad in (lambda: pruning.filter_row_groups(chunks, "id", "eq", 1, most=0), lambda: pruning.row_group_matches(chunks, "id", "like", 1), lambda: pruning.row_group_matches(chunks, "id", "eq", None)):
        with pytest.raises(ScanError):
            bad()
    nan = spark.createDataFrame([(1.0, 2.0)], "lo double, hi double")
    got = nan.select(*[pruning.might_match(F.col("lo"), F.col("hi"), op, float("nan")).alias(op) for op in pruning.ROW]).first()
    assert got.asDict() == {"eq": False, "ne": True, "lt": True, "le": True, "gt": False, "ge": False}  # NaN sorts last


def test_row_groups_and_batches(spark, tmp_path):
    many_groups(f"{tmp_path}/r.parquet")
    rows = scan.with_row_groups(scan.with_rows(scan.open_table(spark, f"{tmp_path}/r.parquet")), footers.footer_row_groups(spark, f"{tmp_path}/r.parquet"))
    assert rows.filter("row_group <> floor(id / 500) OR position <> id % 500").count() == 0
    cut = scan.with_batches(rows, 128, row="position", within=["row_group"]).groupBy("row_group", "batch_id").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(r.n for r in cut.collect()) == sorted([128, 128, 128, 116] * 10)  # batches end with their row group
    found = list(batches.iterate(scan.open_table(spark, f"{tmp_path}/r.parquet"), 777))
    assert sum(b.num_rows for b in found) == 5000 and {b.num_rows for b in found[:-1]} == {777}
    assert found[0].schema.names == ["id", "x", "s"] and list(batches.iterate(spark.createDataFrame([], "a int"))) == []
    assert [r.s for r in scan.read_column(scan.open_table(spark, f"{tmp_path}/r.parquet"), "s", "id", skip=4998, limit=10).collect()] == ["k004998", "k004999"]


def test_page_index(spark, tmp_path):
    many_groups(f"{tmp_path}/r.parquet")
    pages = page_index.page_index(spark, f"{tmp_path}/r.parquet", ["s"])
    assert pages.count() > 10 and pages.filter("null_page").count() == 0
    low, high = F.col("min_bytes").cast("string"), F.col("max_bytes").cast("string")
    hits = pages.filter(pruning.page_overlaps(F.col("null_page"), low, high, "k001234", "k001234")).collect()
    assert len(hits) == 1 and hits[0].row_group == 2 and hits[0].first_row <= 234


def test_bloom_filters_in_files(spark, tmp_path):
    df = spark.range(0, 40_000, 2).withColumnRenamed("id", "k").coalesce(1)
    sink.write(df, f"{tmp_path}/b.parquet", sink.WriterOptions(bloom={"k": 20_000}, dictionary=False))
    keys = hashing.with_xxh64(spark.createDataFrame([(k,) for k in (0, 2, 39_998, 1, 3, 5, 7, 9)], "k long"), "k").collect()
    (name,) = [f"{tmp_path}/b.parquet/{p.name}" for p in (tmp_path / "b.parquet").glob("*.parquet")]
    for found in page_index.bloom_contains(spark, name, "k", [r.xxh64 for r in keys]).values():
        assert found[:3] == [True] * 3 and sum(found[3:]) <= 1


def test_writer_options(spark, tmp_path):
    df = spark.range(100_000).select(F.col("id"), (F.col("id") % 50).cast("string").alias("s"), F.timestamp_micros("id").alias("t")).coalesce(1)
    sink.write(df, f"{tmp_path}/o.parquet", sink.WriterOptions(row_group_size=100_000, page_size=8_000, no_dictionary_columns=("id",), int96_timestamps=True))
    chunks = footers.footer_columns(spark, f"{tmp_path}/o.parquet")
    assert chunks.select("row_group").distinct().count() > 1
    got = {r.name: r for r in chunks.filter("row_group = 0").collect()}
    assert not any("DICTIONARY" in e for e in got["id"].encodings) and any("DICTIONARY" in e for e in got["s"].encodings)
    assert got["t"].physical_type == "INT96"
    sizes = {}
    for level in (1, 19):
        sink.write(df, f"{tmp_path}/z{level}.parquet", sink.WriterOptions(compression="zstd", compression_level=level, dictionary=False))
        sizes[level] = footers.footer_row_groups(spark, f"{tmp_path}/z{level}.parquet").agg(F.sum("compressed_size")).first()[0]
    assert sizes[19] < sizes[1]
    sink.write(df.withColumn("p", F.col("id") % 3), f"{tmp_path}/p.parquet", sink.WriterOptions(partition_by=("p",), max_records_per_file=10_000))
    assert footers.footer_files(spark, f"{tmp_path}/p.parquet").agg(F.max("num_rows"), F.sum("num_rows")).first() == (10_000, 100_000)
    for bad in (sink.WriterOptions(compression="brotli"), sink.WriterOptions(page_size=0)):
        with pytest.raises(ScanError):
            bad.as_options()


def damaged(tmp_path):
    many_groups(f"{tmp_path}/good.parquet")
    raw = (tmp_path / "good.parquet").read_bytes()
    flipped = bytearray(raw)
    flipped[len(raw) // 3] ^= 0x40
    for name, content in {"text": b"This is no table, but some text.", "short": b"PAR1", "cut": raw[: len(raw) // 2], "magic": b"XXXX" + raw[4:], "tail": raw[:-4] + b"XXXX", "length": raw[:-8] + b"\xff\xff\xff\x7fPAR1", "thrift": raw[:-400] + bytes(392) + raw[-8:], "flip": bytes(flipped)}.items():
        (tmp_path / f"{name}.parquet").write_bytes(content)


def test_damaged_files(spark, tmp_path):
    damaged(tmp_path)
    got = {r.path.rpartition("/")[2].removesuffix(".parquet"): Status[r.status] for r in checks.validate(spark, str(tmp_path)).collect()}
    assert got == {
        "good": Status.OK, "text": Status.INVALID_MAGIC, "short": Status.FILE_TRUNCATED, "cut": Status.FILE_TRUNCATED, "magic": Status.INVALID_MAGIC,
        "tail": Status.FILE_TRUNCATED, "length": Status.INVALID_FOOTER, "thrift": Status.INVALID_FOOTER, "flip": Status.CRC_MISMATCH,
    }
    for engine in ("spark", "arrow"):
        with pytest.raises(Exception, match="(?i)crc|checksum"):
            scan.open_table(spark, f"{tmp_path}/flip.parquet", engine=engine).agg(F.sum("id"), F.sum("x"), F.max("s")).collect()
    scan.open_table(spark, f"{tmp_path}/flip.parquet", verify_checksums=False, engine="spark").agg(F.sum("id"), F.sum("x")).collect()  # unchecked, as asked
    with pytest.raises(ScanError) as e:
        scan.open_table(spark, f"{tmp_path}/none.parquet")
    assert e.value.status is Status.FILE_NOT_FOUND
    with pytest.raises(ScanError):
        scan.open_table(spark, f"{tmp_path}/text.parquet")


def test_buffers(spark, tmp_path):
    many_groups(f"{tmp_path}/r.parquet", 1000)
    got = scan.read_buffers(spark, f"{tmp_path}/r.parquet", "id long, x double, s string")
    assert got.agg(F.sum("id"), F.max("s")).first() == (499_500, "k000999")


def test_random_tables_round_trip(spark, tmp_path):
    rng = random.Random(7)
    makers = {
        "boolean": lambda: rng.random() < 0.5, "int": lambda: rng.choice([0, -(2**31), 2**31 - 1, rng.randint(-999, 999)]), "long": lambda: rng.choice([-(2**63), 2**63 - 1, rng.getrandbits(40)]),
        "float": lambda: float(np.float32(rng.choice([0.0, float("inf"), rng.random()]))), "double": lambda: rng.choice([float("-inf"), 1e-300, rng.random()]), "string": lambda: "".join(rng.choice("aé中\0 ") for _ in range(rng.randint(0, 9))), "binary": lambda: bytearray(rng.randbytes(rng.randint(0, 20))),
    }
    for k in range(8):
        kinds = [rng.choice(list(makers)) for _ in range(rng.randint(1, 16))]
        sparse = [rng.random() < 0.5 for _ in kinds]
        rows = [tuple(None if s and rng.random() < 0.3 else makers[t]() for t, s in zip(kinds, sparse)) for _ in range(rng.randint(1, 400))]
        df = spark.createDataFrame(rows, ", ".join(f"c{i} {t}" for i, t in enumerate(kinds)))
        sink.write(df, f"{tmp_path}/f{k}.parquet", sink.WriterOptions(compression=rng.choice(CODECS), dictionary=rng.random() < 0.5, version_2=rng.random() < 0.5, page_size=rng.choice([100, 1 << 20])))
        for engine in ("auto", "arrow"):
            got = scan.open_table(spark, f"{tmp_path}/f{k}.parquet", engine=engine).collect()
            plain = lambda r: str(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r))
            assert sorted(map(plain, got)) == sorted(map(plain, rows))


def test_failed_writes_leave_no_table(spark, tmp_path):
    broken = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        sink.write(broken, f"{tmp_path}/t.parquet")
    assert not list(tmp_path.rglob("part-*"))
    with pytest.raises(ScanError) as e:
        scan.open_table(spark, f"{tmp_path}/t.parquet")
    assert e.value.status is Status.FILE_NOT_FOUND
    sink.write(spark.range(3), f"{tmp_path}/t.parquet", mode="overwrite")
    with pytest.raises(Exception, match="(?i)exists"):
        sink.write(spark.range(3), f"{tmp_path}/t.parquet")
    assert scan.open_table(spark, f"{tmp_path}/t.parquet").count() == 3


def test_errors():
    e = ScanError(Status.CRC_MISMATCH, "page 3", path="f", row_group=1, column=2)
    assert str(e).splitlines()[:2] == ["CRC_MISMATCH (71): page 3", "at path=f row_group=1 column=2"] and e.hint in str(e) and not e.recoverable
    assert Status.DECODE in RECOVERABLE and status_of(e) is Status.CRC_MISMATCH and status_of(ValueError("what")) is Status.INTERNAL


def test_names_of_files_say_nothing_of_a_failure():
    for text, status in (("cannot open /data/codec/crc/footer.parquet", Status.INTERNAL), ("no such file: '/x/encoding'", Status.FILE_NOT_FOUND), ("unsupported encoding in /x/y", Status.INVALID_ENCODING), ("bad page of `codec`", Status.INTERNAL)):
        assert status_of(OSError(text)) is status


def test_spark_alone_misreads_delta_strings(spark, tmp_path):
    """What the detour through Arrow is for: of a file of format version 2, Spark's vectorized reader gives other strings, and no error. If this fails, the detour can go."""
    df = spark.createDataFrame([(k, f"key {k:05}") for k in range(3000)], "k long, v string").coalesce(1)
    sink.write(df, f"{tmp_path}/d.parquet", sink.WriterOptions(version_2=True, dictionary=False))
    wrong = lambda **how: sum(r.v != f"key {r.k:05}" for r in scan.open_table(spark, f"{tmp_path}/d.parquet", **how).collect())
    assert wrong(engine="spark") > 0 == wrong()
    with scan.row_reader(spark):
        assert wrong(engine="spark") == 0
    assert wrong(engine="spark") > 0


def test_nested_schema_elements(spark, tmp_path):
    """A record with a group, and a repeated group: the tree, repetitions and levels that the footer has."""
    required = lambda n, t: pa.field(n, t, nullable=False)
    table = pa.table(
        [pa.array([1], pa.int32()), pa.array(["x"]), pa.array([{"street": "s", "city": None}], pa.struct([required("street", pa.string()), pa.field("city", pa.string())])), pa.array([[{"number": "1", "type": None}]], pa.list_(required("element", pa.struct([required("number", pa.string()), pa.field("type", pa.string())]))))],
        schema=pa.schema([required("id", pa.int32()), pa.field("name", pa.string()), pa.field("address", pa.struct([required("street", pa.string()), pa.field("city", pa.string())])), required("phones", pa.list_(required("element", pa.struct([required("number", pa.string()), pa.field("type", pa.string())]))))]),
    )
    pq.write_table(table, f"{tmp_path}/n.parquet")
    got = [(r.full_name, r.parent, r.repetition, r.num_children, r.physical_type, r.max_def, r.max_rep, r.column) for r in footers.schema_elements(spark, f"{tmp_path}/n.parquet").orderBy("element").collect()]
    assert got == [
        ("", None, None, 4, None, 0, 0, None), ("id", 0, "REQUIRED", 0, "INT32", 0, 0, 0), ("name", 0, "OPTIONAL", 0, "BYTE_ARRAY", 1, 0, 1), ("address", 0, "OPTIONAL", 2, None, 1, 0, None),
        ("address.street", 3, "REQUIRED", 0, "BYTE_ARRAY", 1, 0, 2), ("address.city", 3, "OPTIONAL", 0, "BYTE_ARRAY", 2, 0, 3), ("phones", 0, "REQUIRED", 1, None, 0, 0, None), ("phones.list", 6, "REPEATED", 1, None, 1, 1, None),
        ("phones.list.element", 7, "REQUIRED", 2, None, 1, 1, None), ("phones.list.element.number", 8, "REQUIRED", 0, "BYTE_ARRAY", 1, 1, 4), ("phones.list.element.type", 8, "OPTIONAL", 0, "BYTE_ARRAY", 2, 1, 5),
    ]


def test_cursor(spark, tmp_path):
    many_groups(f"{tmp_path}/r.parquet")
    cursor = scan.Cursor(scan.with_rows(scan.open_table(spark, f"{tmp_path}/r.parquet")), 500, first=1000)  # the third row group
    assert (cursor.remaining(), cursor.has_next(), cursor.skip(120), cursor.remaining()) == (500, True, 120, 380)
    assert sorted(r.id for r in cursor.read(30).collect()) == list(range(1120, 1150)) and cursor.remaining() == 350
    assert cursor.read(9999).count() == 350 and not cursor.has_next() and cursor.read(5).count() == 0 == cursor.skip(3)
    with pytest.raises(ScanError):
        cursor.skip(-1)


def test_files_of_different_columns_through_arrow(spark, tmp_path):
    (tmp_path / "t.parquet").mkdir()
    pq.write_table(pa.table({"a": [1, 2], "b": ["x", "y"]}), f"{tmp_path}/t.parquet/0.parquet")
    pq.write_table(pa.table({"a": [3], "c": [0.5]}), f"{tmp_path}/t.parquet/1.parquet")
    df = arrow_scan.scan(spark, f"{tmp_path}/t.parquet", with_rows=True)
    assert sorted((r.a, r.b, r.c, r.row_index, r.file_path[-9:]) for r in scan.with_rows(df).collect()) == [(1, "x", None, 0, "0.parquet"), (2, "y", None, 1, "0.parquet"), (3, None, 0.5, 0, "1.parquet")]
    assert scan.open_table(spark, f"{tmp_path}/t.parquet", engine="arrow", columns=["c"]).columns == ["c"]
    pq.write_table(pa.table({"a": ["text"]}), f"{tmp_path}/t.parquet/2.parquet")
    with pytest.raises(ScanError) as e:
        arrow_scan.scan(spark, f"{tmp_path}/t.parquet")
    assert e.value.status is Status.TYPE_MISMATCH


def test_levels_that_a_codec_has(spark, tmp_path):
    for codec, level in (("gzip", 10), ("gzip", -1), ("snappy", 1), ("lz4_raw", 3), ("none", 0), ("zstd", 23), ("zstd", 0)):
        with pytest.raises(ScanError) as e:
            sink.WriterOptions(compression=codec, compression_level=level).as_options()
        assert e.value.status is Status.INVALID_ARGUMENT
    df, sizes = spark.range(60_000).select((F.col("id") * F.col("id") % 977).cast("string").alias("s")).coalesce(1), []
    for level in (1, 4, 9):
        sink.write(df, f"{tmp_path}/g{level}", sink.WriterOptions(compression="gzip", compression_level=level, dictionary=False))
        sizes.append(footers.footer_row_groups(spark, f"{tmp_path}/g{level}").agg(F.sum("compressed_size")).first()[0])
    assert len(set(sizes)) == 3 and sizes[2] == min(sizes)


def test_page_index_over_many_files(spark, tmp_path):
    spark.range(0, 40_000, 1, 7).write.option("parquet.page.size", 4096).option("parquet.enable.dictionary", "false").parquet(f"{tmp_path}/m.parquet")
    pages = page_index.page_index(spark, f"{tmp_path}/m.parquet")
    assert pages.select("path").distinct().count() == 7 and "MapInArrow" in pages._jdf.queryExecution().executedPlan().toString()
    bounds = [(int.from_bytes(r.min_bytes, "little"), int.from_bytes(r.max_bytes, "little")) for r in pages.collect()]
    assert sorted(b for x in bounds for b in x)[0] == 0 and max(b for _, b in bounds) == 39_999 and sum(b - a + 1 for a, b in bounds) == 40_000
