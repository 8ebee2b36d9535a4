"""Levels, encodings, hashes and bloom filters against plain Python."""

import random
import struct

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratascan.errors import ScanError
from stratascan.functions import bloom, encodings, hashing
from stratascan.operators import levels, stats


def test_nested_schema_levels(spark):
    phones = T.ArrayType(T.StructType([T.StructField("number", T.StringType(), False), T.StructField("type", T.StringType())]), False)
    address = T.StructType([T.StructField("street", T.StringType(), False), T.StructField("city", T.StringType())])
    schema = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("name", T.StringType()), T.StructField("address", address), T.StructField("phones", phones, False), T.StructField("m", T.MapType(T.StringType(), T.LongType(), False), False)])
    got = {r.path: (r.max_def, r.max_rep) for r in levels.schema_levels(spark, schema).filter("is_leaf").collect()}
    assert got == {"id": (0, 0), "name": (1, 0), "address.street": (1, 0), "address.city": (2, 0), "phones.list.element.number": (1, 1), "phones.list.element.type": (2, 1), "m.key_value.key": (1, 1), "m.key_value.value": (1, 1)}
    assert levels.leaf_index(schema, "city") == 3 and levels.leaf_index(schema, "address.street") == 2 and levels.leaf_index(schema, "none") == -1


def test_list_levels(spark):
    lists = {1: None, 2: [], 3: [None], 4: [7, None, 9]}
    df = spark.createDataFrame(list(lists.items()), "id long, xs array<int>")
    entries = levels.list_levels(df, "xs", ["id"])
    got = sorted((r.id, r.pos, r.rep_level, r.def_level, r.value) for r in entries.collect())
    assert got == [(1, 0, 0, 0, None), (2, 0, 0, 1, None), (3, 0, 0, 2, None), (4, 0, 0, 3, 7), (4, 1, 1, 2, None), (4, 2, 1, 3, 9)]
    assert {r.id: r.value for r in levels.from_levels(entries, ["id"]).collect()} == lists


def test_statistics(spark):
    nan = float("nan")
    rows = [("a", 1.0, "z" * 300), ("a", nan, "y"), ("a", None, None), ("b", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, s string")
    got = {r.g: r for r in stats.column_statistics(df, "x", ["g"]).collect()}
    assert (got["a"].num_values, got["a"].null_count, got["a"].min_value, got["a"].has_min_max, got["a"].distinct_count) == (3, 1, 1.0, True, 2)
    assert got["a"].max_value != got["a"].max_value  # NaN is last
    assert (got["b"].min_value, got["b"].has_min_max, got["b"].null_count) == (None, False, 1)
    assert stats.column_statistics(df, "s", []).first().max_value == "z" * 300  # long values count
    merged = stats.merge(stats.column_statistics(df, "s", ["g"], distinct="approximate")).first()
    assert (merged.num_values, merged.null_count, merged.min_value) == (4, 2, "y")


def test_page_index_relation(spark):
    rows = [(c, k, None if c == "nulls" and k < 4 else {"up": k, "down": -k, "mixed": k * 7 % 5, "flat": 1, "nulls": k}[c]) for c in ("up", "down", "mixed", "flat", "nulls") for k in range(10)]
    pages = stats.column_index(spark.createDataFrame(rows, "c string, k int, v int"), "v", "k", ["c"], 4)
    got = sorted(tuple(r)[1:] for r in pages.filter("c = 'nulls'").collect())
    assert got == [(0, 0, 4, True, 4, None, None), (1, 4, 4, False, 0, 4, 7), (2, 8, 2, False, 0, 8, 9)]
    orders = {r.c: r.boundary_order for r in stats.boundary_order(pages, ["c"]).collect()}
    assert orders == {"up": "ASCENDING", "down": "DESCENDING", "mixed": "UNORDERED", "flat": "ASCENDING", "nulls": "ASCENDING"}


@pytest.fixture(scope="module")
def chunked(spark):
    rng = random.Random(3)
    rows = []
    for c in range(3):
        v = 0
        for k in range(rng.choice([1, 250, 400])):
            v = v if rng.random() < 0.6 else rng.randint(-50, 50)
            rows.append((c, k, None if rng.random() < 0.05 else v, rng.choice(["pre", "prefix", "pref", "", "é", "éa"]) + rng.choice(["", "x"])))
    return rows, spark.createDataFrame(rows, "c int, k int, v long, s string")


def test_dictionary(spark, chunked):
    rows, df = chunked
    coded = encodings.dictionary_encode(df, "v", "k", ["c"])
    seen, want = {}, []
    for c, k, v, _ in rows:
        own = seen.setdefault(c, {})
        want.append((c, k, None if v is None else own.setdefault(v, len(own))))
    assert sorted(map(str, map(tuple, coded.collect()))) == sorted(map(str, want))
    back = encodings.dictionary_decode(coded, encodings.dictionary(df, "v", "k", ["c"]), "v", "k", ["c"])
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((c, k, v)) for c, k, v, _ in rows)


def test_runs(spark, chunked):
    rows, df = chunked
    table = encodings.runs(df, "v", "k", ["c"])
    want = []
    for c, k, v, _ in rows:
        if want and want[-1][0] == c and want[-1][2] == v:
            want[-1][4] += 1
        else:
            want.append([c, want[-1][1] + 1 if want and want[-1][0] == c else 0, v, k, 1])
    assert sorted(map(str, map(list, table.collect()))) == sorted(map(str, want))
    back = encodings.expand_runs(table, "v", ["c"])
    assert sorted(str((r.c, r.pos, r.v)) for r in back.collect()) == sorted(str((c, k, v)) for c, k, v, _ in rows)


def test_deltas_and_prefixes(spark, chunked):
    rows, df = chunked
    full = df.filter("v is not null")
    coded = encodings.delta_encode(full, "v", "k", ["c"])
    back = {(r.c, r.k): r.v for r in encodings.delta_decode(coded, "v", "k", ["c"]).collect()}
    assert back == {(c, k): v for c, k, v, _ in rows if v is not None}
    for r in encodings.delta_blocks(coded, "k", ["c"]).collect():
        assert 1 <= r.n <= 128 and 0 <= r.bit_width <= 8
    text = {}
    for r in sorted(encodings.prefix_encode(df, "s", "k", ["c"]).collect()):
        text[r.c] = text.get(r.c, b"")[: r.prefix_length] + bytes(r.suffix)
        before = next((s.encode() for c, k, _, s in rows if (c, k) == (r.c, r.k - 1)), b"")
        own = next(s.encode() for c, k, _, s in rows if (c, k) == (r.c, r.k))
        assert text[r.c] == own and (r.prefix_length == len(own) or r.prefix_length == len(before) or own[r.prefix_length] != before[r.prefix_length])
    assert {(r.c, r.k): r.byte_length for r in encodings.delta_lengths(df, "s", "k", ["c"]).collect()} == {(c, k): len(s.encode()) for c, k, _, s in rows}


@pytest.mark.parametrize("width", [1, 3, 8, 17, 31])
def test_bit_packing(spark, width):
    rng = random.Random(width)
    values = [rng.getrandbits(width) for _ in range(43)]
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(values)], "c int, k int, v long")
    packed = encodings.bit_pack(df, "v", "k", ["c"], width)
    raw = b"".join(bytes(r.packed) for r in packed.orderBy("group").collect())
    padded = values + [0] * (-len(values) % 8)
    assert raw == sum(v << width * k for k, v in enumerate(padded)).to_bytes(width * len(padded) // 8, "little")
    assert [r.value for r in encodings.bit_unpack(packed, ["c"], width).orderBy("pos").collect()] == padded


def leb(v):
    out = bytearray()
    while True:
        v, low = v >> 7, v & 127
        out.append(low | (128 if v else 0))
        if not v:
            return bytes(out)


def test_numbers(spark):
    values = [0, 1, -1, 127, 128, 300, -300, 2**31, -(2**31), 2**62, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    zig = df.select("v", encodings.zigzag(F.col("v")).alias("z")).withColumn("back", encodings.unzigzag(F.col("z")))
    for r in zig.collect():
        assert r.z % 2**64 == ((r.v << 1) ^ (r.v >> 63)) % 2**64 and r.back == r.v
    for r in df.select("v", encodings.varint(F.col("v")).alias("b")).withColumn("back", encodings.unvarint(F.col("b"))).collect():
        assert bytes(r.b) == leb(r.v % 2**64) and r.back == r.v


def test_byte_streams(spark):
    values = [1.5, -0.0, float("inf"), 3e-300]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "c int, k int, v double")
    streams = encodings.byte_stream_split(df, "v", "k", ["c"])
    raw = [struct.pack("<d", v) for v in values]
    assert {r.stream: bytes(r.bytes) for r in streams.collect()} == {b: bytes(x[b] for x in raw) for b in range(8)}
    assert [r.value for r in encodings.byte_stream_join(streams, ["c"]).orderBy("pos").collect()] == values


def test_hash_vectors(spark):
    df = spark.createDataFrame([("123456789", 5_000_000_000, 7, 1.5), ("", -1, -(2**31), float("nan")), (None, None, None, None)], "s string, n long, i int, d double")
    crc = [r[0] for r in df.select(hashing.crc32(F.col("s"))).collect()]
    assert crc == [0xCBF43926, 0, None]
    got = df.select(hashing.xxh64(F.col("s"), "string"), hashing.xxh64(F.col("n"), "bigint"), hashing.xxh64(F.col("i"), "int"), hashing.xxh64(F.col("d"), "double")).collect()
    signed = lambda raw: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(raw, 0)))[0]
    assert got[0][1] == 6837472140094837584 and got[1][0] % 2**64 == 0xEF46DB3751D8E999
    assert tuple(got[0]) == (signed(b"123456789"), signed(struct.pack("<q", 5_000_000_000)), signed(struct.pack("<i", 7)), signed(struct.pack("<d", 1.5)))
    assert tuple(got[1])[1:3] == (signed(struct.pack("<q", -1)), signed(struct.pack("<i", -(2**31)))) and tuple(got[2]) == (None,) * 4


class PlainBloom:
    def __init__(self, blocks):
        self.words = [[0] * 8 for _ in range(blocks)]

    def add(self, h):
        block = self.words[((h >> 32) * len(self.words)) >> 32]
        for k, s in enumerate(bloom.SALTS):
            block[k] |= 1 << (((h & 0xFFFFFFFF) * s & 0xFFFFFFFF) >> 27)


def test_bloom_bits(spark):
    keys = list(range(-300, 300)) + [2**62]
    plain = PlainBloom(5)
    for k in keys:
        plain.add(xxhash.xxh64_intdigest(struct.pack("<q", k), 0))
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    built = bloom.build(df, "k", 5)
    raw = b"".join(w.to_bytes(4, "little") for b in plain.words for w in b)
    assert bloom.to_bytes(built, 5) == raw
    assert sorted(map(tuple, bloom.from_bytes(spark, raw).collect())) == sorted(map(tuple, built.collect()))
    got = {r.k: r.might_contain for r in bloom.check(df, "k", built, 5).collect()}
    assert got.pop(None) is None and all(got.values())
    halves = [bloom.build(df.filter(F.col("k") % 2 == m), "k", 5) for m in (0, 1, -1)]
    assert bloom.to_bytes(bloom.merge(*halves), 5) == raw
    for bad in (lambda: bloom.blocks_for(0), lambda: bloom.blocks_for(5, 1.0), lambda: bloom.from_bytes(spark, b"x" * 31)):
        with pytest.raises(ScanError):
            bad()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**9), st.floats(1e-6, 0.5))
def test_bloom_sizes(ndv, fpp):
    if ndv:
        assert bloom.blocks_for(ndv, fpp) >= 1


def test_int96_order(spark):
    """Days count before nanoseconds, whatever the order of the bytes."""
    values = [(2440588, 5), (2440588, 86_399_999_999_999), (2440589, 0), (2451545, 1), (2440588, 256)]
    rows = [(d, n, n.to_bytes(8, "little") + d.to_bytes(4, "little")) for d, n in values]
    df = spark.createDataFrame([*rows, (0, 0, b"short")], "d long, n long, raw binary").withColumn("o", stats.int96_order(F.col("raw")))
    got = [(r.d, r.n) for r in df.filter("o is not null").orderBy("o").collect()]
    assert got == sorted(values) and df.filter("o is null").count() == 1


def test_blocks_of_a_size():
    assert [bloom.blocks_in(n) for n in (0, 1, 32, 33, 4096)] == [1, 1, 1, 2, 128]
    with pytest.raises(ScanError):
        bloom.blocks_in(-1)


def test_string_decodes_refuse_what_does_not_fit(spark):
    bad = spark.createDataFrame([(0, [2, 5], b"abc")], "c int, lengths array<int>, bytes binary")
    with pytest.raises(Exception, match="lengths that the bytes"):
        encodings.delta_length_decode(bad, ["c"]).collect()
    worse = spark.createDataFrame([(0, 0, 0, b"ab"), (0, 1, 3, b"")], "c int, k int, prefix_length int, suffix binary")
    with pytest.raises(Exception, match="prefix longer"):
        encodings.prefix_decode(worse, "k", ["c"]).collect()
    assert encodings.prefix_decode(worse.filter("false"), "k", ["c"]).count() == 0


def test_prefixes_of_long_texts(spark):
    """Steps grow with the logarithm of a text's length: two million bytes take no list of two million numbers."""
    rng, texts = random.Random(5), [None, "", "a", "ab", "ab", "b"]
    texts += ["x" * rng.randrange(600) + rng.choice(["", "é", "è", "y"]) + "z" * rng.randrange(3) for _ in range(150)]
    texts += ["q" * n for n in (1, 127, 128, 129, 255, 256, 257, 0, 2_000_000, 2_000_001, 1_999_999)] + ["q" * 1_500_000 + "r" + "q" * 500_000]
    df = spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], "c int, k int, s string")
    coded = encodings.prefix_encode(df, "s", "k", ["c"])
    assert "sequence(" not in coded._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: (r.prefix_length, r.suffix) for r in coded.collect()}
    for k, (before, own) in enumerate(zip([None, *texts], texts)):
        if own is None:
            continue
        a, b = (before or "").encode(), own.encode()
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert (got[k][0], bytes(got[k][1])) == (n, b[n:]), k


def test_long_texts_come_back_from_prefixes(spark):
    texts = ["p" * n + tail for n in (0, 1_000_000, 999_999, 1_000_001, 5) for tail in ("", "é", "è")]
    df = spark.createDataFrame([(c, k, t) for c in range(2) for k, t in enumerate(texts)], "c int, k int, s string")
    back = encodings.prefix_decode(encodings.prefix_encode(df, "s", "k", ["c"]), "k", ["c"])
    assert "sequence(" not in back._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.c, r.pos): bytes(r.value).decode() for r in back.collect()} == {(c, k): t for c in range(2) for k, t in enumerate(texts)}


def test_prefixes_are_decoded_row_by_row(spark):
    """Chunks are no lists: rows stay where the window put them, go through in small batches, and the value is shuffled once."""
    rng = random.Random(3)
    texts = {(c, k): "p" * rng.randrange(40) + rng.choice(["", "é", "è"]) for c in range(5) for k in range(rng.randrange(1, 60))}
    texts |= {(9, k): "q" * 1_000_000 + str(k) for k in range(40)}
    df = spark.createDataFrame([(*key, t) for key, t in texts.items()], "c int, k int, s string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        back = encodings.prefix_decode(encodings.prefix_encode(df, "s", "k", ["c"]), "k", ["c"])
        plan = back._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and plan.count("hashpartitioning") == 1 and "[lag(_v" in plan
        assert {(r.c, r.pos): bytes(r.value).decode() for r in back.collect()} == texts
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
