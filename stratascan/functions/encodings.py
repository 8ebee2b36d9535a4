"""Value encodings as relations: what each encoding stores, row by row or run by run.

Encodings work within a chunk, as in a file: `within` names the columns that make one, and `order`
the row order in it. Windows partition by chunk, so chunks are encoded in parallel; files are
written with these encodings by the sink's options.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Values of so many bytes leave a Python worker at once; a longer one alone.
BATCH_BYTES = 1 << 24


def _in(within: Sequence[str], order: str):
    return Window.partitionBy(*within).orderBy(order)


# ---- dictionary


def dictionary(df: DataFrame, value: str, order: str, within: Sequence[str]) -> DataFrame:
    """(within, index, value): the chunk's values, numbered from 0 as they first occur; nulls have no entry."""
    first = df.filter(F.col(value).isNotNull()).groupBy(*within, value).agg(F.min(order).alias("first_pos"))
    return first.withColumn("index", F.row_number().over(Window.partitionBy(*within).orderBy("first_pos")) - 1)


def dictionary_encode(df: DataFrame, value: str, order: str, within: Sequence[str]) -> DataFrame:
    """(within, order, index): the index of each row's value; null for null."""
    entries = dictionary(df, value, order, within).drop("first_pos")
    return df.select(*within, order, value).join(entries, [*within, value], "left").select(*within, order, "index")


def dictionary_decode(encoded: DataFrame, entries: DataFrame, value: str, order: str, within: Sequence[str]) -> DataFrame:
    return encoded.join(entries.select(*within, "index", value), [*within, "index"], "left").select(*within, order, value)


# ---- runs


def runs(df: DataFrame, value: str, order: str, within: Sequence[str]) -> DataFrame:
    """(within, run, value, first_pos, length): maximal runs of equal neighbours, nulls being equal."""
    w = _in(within, order)
    new = F.row_number().over(w).eqNullSafe(F.lit(1)) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    marked = df.select(*within, order, value, new.cast("int").alias("_new")).withColumn("run", F.sum("_new").over(w) - 1)
    return marked.groupBy(*within, "run").agg(F.first(value).alias(value), F.min(order).alias("first_pos"), F.count(F.lit(1)).alias("length"))


def expand_runs(run_table: DataFrame, value: str, within: Sequence[str]) -> DataFrame:
    """(within, pos, value): the rows again, pos counting from the chunk's start."""
    start = F.coalesce(F.sum("length").over(_in(within, "run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return run_table.withColumn("_start", start).select(*within, value, F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("length") - 1)).alias("pos"))


def hybrid_kind(length: Column, least: int = 8) -> Column:
    """How the run-length / bit-packed hybrid stores a run: RLE from eight equal values on."""
    return F.when(length >= least, F.lit("RLE")).otherwise(F.lit("BIT_PACKED"))


# ---- deltas


def delta_encode(df: DataFrame, value: str, order: str, within: Sequence[str]) -> DataFrame:
    """(within, order, delta): the first value, then differences to the row before."""
    w = _in(within, order)
    return df.select(*within, order, (F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))).alias("delta"))


def delta_decode(encoded: DataFrame, value: str, order: str, within: Sequence[str]) -> DataFrame:
    return encoded.select(*within, order, F.sum("delta").over(_in(within, order)).alias(value))


def delta_blocks(encoded: DataFrame, order: str, within: Sequence[str], block: int = 128) -> DataFrame:
    """(within, block, n, min_delta, bit_width): what each block of differences needs, after the chunk's first value."""
    w = _in(within, order)
    placed = encoded.withColumn("_k", F.row_number().over(w) - 2).filter("_k >= 0").withColumn("block", F.call_function("div", F.col("_k"), F.lit(block)))
    out = placed.groupBy(*within, "block").agg(F.count(F.lit(1)).alias("n"), F.min("delta").alias("min_delta"), F.max("delta").alias("_max"))
    spread = F.col("_max") - F.col("min_delta")
    return out.withColumn("bit_width", F.when(spread == 0, 0).otherwise(F.length(F.bin(spread)))).drop("_max")


def delta_lengths(df: DataFrame, value: str, order: str, within: Sequence[str]) -> DataFrame:
    """(within, order, byte_length): lengths as the delta-length encoding stores before the bytes."""
    return df.select(*within, order, F.octet_length(value).alias("byte_length"))


def delta_length_encode(df: DataFrame, value: str, order: str, within: Sequence[str]) -> DataFrame:
    """(within, lengths, bytes): a row for each chunk, the byte lengths of its values in order and the bytes of all; nulls have neither."""
    raw = F.col(value).cast("binary")
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), raw.alias("v"))))
    chunks = df.filter(F.col(value).isNotNull()).groupBy(*within).agg(rows.alias("_rows"))
    return chunks.select(*within, F.transform("_rows", lambda r: F.octet_length(r["v"])).alias("lengths"), F.unhex(F.array_join(F.transform("_rows", lambda r: F.hex(r["v"])), "")).alias("bytes"))


def delta_length_decode(chunks: DataFrame, within: Sequence[str]) -> DataFrame:
    """(within, pos, value): the chunks' values again, as bytes; pos counts from the chunk's start."""
    return _chunk_values(chunks, within, lambda r: _slices(r["lengths"], r["bytes"]))


def _slices(lengths: list[int], raw: bytes) -> list[bytes]:
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    if lengths and (min(lengths) < 0 or ends[-1] > len(raw)):
        raise ValueError("lengths that the bytes don't have")
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _shared_bytes(v: Column, b: Column) -> Column:
    """How many leading bytes two binaries share: the number's bits from the highest down, each set if the bytes that it adds are equal too. A null shares all.

    The pair is a list's only element: a step on a column would copy the whole binary out of its row each time it looks at it.
    """
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(31))))

    def shared(pair: Column) -> Column:
        v, b = pair["v"], pair["b"]
        n = F.least(F.octet_length(v), F.octet_length(b))
        equal = lambda at, step: F.coalesce(F.substring(v, at + 1, step) == F.substring(b, at + 1, step), F.lit(True))
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when((step <= n - at) & equal(at, step), at + step).otherwise(at))

    return F.get(F.transform(F.array(F.struct(v.alias("v"), b.alias("b"))), shared), F.lit(0))


def prefix_encode(df: DataFrame, value: str, order: str, within: Sequence[str]) -> DataFrame:
    """(within, order, prefix_length, suffix): bytes shared with the value before, and the rest of the bytes."""
    rows = df.select(*within, order, F.col(value).cast("binary").alias("_v"))  # the value once, as bytes, is what the window shuffles
    before = F.coalesce(F.lag("_v").over(_in(within, order)), F.lit(b""))
    rows = rows.withColumn("_b", before).withColumn("prefix_length", _shared_bytes(F.col("_v"), F.col("_b")))
    return rows.select(*within, order, "prefix_length", F.expr("substring(_v, prefix_length + 1)").alias("suffix"))


def prefix_decode(encoded: DataFrame, order: str, within: Sequence[str]) -> DataFrame:
    """(within, pos, value): the values of prefix_encode again, as bytes. Each is made of the one before, so a chunk's rows come in order, one by one; no chunk is ever held whole."""
    types = dict(encoded.dtypes)
    # The window deals rows by chunk and sorts them, and leaves them so: rows of prefix_encode already are, and stay where they are.
    placed = encoded.select(*within, (F.row_number().over(_in(within, order)) - 1).cast("long").alias("pos"), "prefix_length", "suffix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, due = b"", 0
        for batch in batches:
            *same, at, prefixes, suffixes = batch.columns
            start, size, out = 0, 0, []
            for pos, n, suffix in zip(*(c.to_pylist() for c in (at, prefixes, suffixes))):
                if pos == 0:
                    last = b""
                elif pos != due:
                    raise ValueError("a chunk's rows out of order")
                if n > len(last):
                    raise ValueError("a prefix longer than the value before")
                out.append(last := last[:n] + suffix)
                due, size = pos + 1, size + len(last)
                if size >= BATCH_BYTES or start + len(out) == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, len(out)) for c in [*same, at]), pa.array(out, pa.binary())], [*within, "pos", "value"])
                    start, size, out = start + len(out), 0, []

    return placed.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in within), "pos long", "value binary"]))


def _chunk_values(chunks: DataFrame, within: Sequence[str], values: Callable[[dict], list[bytes]]) -> DataFrame:
    types = dict(chunks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                found = values(row)
                same = [batch.column(batch.schema.get_field_index(c)).slice(k, 1).take(pa.array(np.zeros(len(found), np.int64))) for c in within]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(found)), pa.int64()), pa.array(found, pa.binary())], [*within, "pos", "value"])

    return chunks.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in within), "pos long", "value binary"]))


# ---- bits and bytes


def zigzag(column: Column) -> Column:
    """Signed to unsigned, small magnitudes to small numbers."""
    v = column.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(column: Column) -> Column:
    v = column.cast("long")
    return F.shiftrightunsigned(v, 1).bitwiseXOR(F.negate(v.bitwiseAND(F.lit(1))))


def varint(column: Column) -> Column:
    """The bytes of an unsigned LEB128 number."""
    v = column.cast("long")
    n = F.ceil(F.length(F.bin(v)) / F.lit(7)).cast("int")
    groups = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.expr("0") + F.call_function("shiftrightunsigned", v, k * 7).bitwiseAND(F.lit(127)) + F.when(k < n - 1, 128).otherwise(0))
    return F.unhex(F.array_join(F.transform(groups, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def unvarint(column: Column) -> Column:
    """The number that LEB128 bytes stand for."""
    digits = F.hex(column)
    at = F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1)
    parts = F.transform(at, lambda k: F.call_function("shiftleft", F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127)), k * 7))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def bit_pack(df: DataFrame, value: str, order: str, within: Sequence[str], width: int) -> DataFrame:
    """(within, group, packed): eight values at a time in `width` bits each, least bit first; a last short group is filled with zeros."""
    placed = df.select(*within, F.col(value).cast("long").alias("_v"), (F.row_number().over(_in(within, order)) - 1).alias("_k")).withColumn("group", F.call_function("div", F.col("_k"), F.lit(8)))
    sorted_values = F.transform(F.sort_array(F.collect_list(F.struct("_k", "_v"))), lambda x: x["_v"])
    grouped = placed.groupBy(*within, "group").agg(sorted_values.alias("_vs"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.lpad(F.bin(F.coalesce(F.get(F.col("_vs"), k), F.lit(0))), width, "0"))
    bits = grouped.withColumn("_bits", F.array_join(F.reverse(filled), ""))
    octets = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.lpad(F.conv(F.substring(F.col("_bits"), F.lit(8 * width - 7) - 8 * k, F.lit(8)), 2, 16), 2, "0"))
    return bits.select(*within, "group", F.unhex(F.array_join(octets, "")).alias("packed"))


def bit_unpack(packed: DataFrame, within: Sequence[str], width: int) -> DataFrame:
    """(within, pos, value) of packed groups, the filling included."""
    digits = F.hex("packed")
    octets = F.transform(F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1)), lambda k: F.lpad(F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 2), 8, "0"))
    bits = packed.withColumn("_bits", F.array_join(octets, ""))
    values = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substring(F.col("_bits"), F.lit(7 * width + 1) - k * width, F.lit(width)), 2, 10).cast("long"))
    return bits.select(*within, "group", F.posexplode(values).alias("_i", "value")).select(*within, (F.col("group") * 8 + F.col("_i")).alias("pos"), "value")


def byte_stream_split(df: DataFrame, value: str, order: str, within: Sequence[str], kind: str = "double") -> DataFrame:
    """(within, stream, bytes): byte k of each of a chunk's values, together. One chunk at a time in Arrow, as in a file."""
    dtype = {"float": "<f4", "double": "<f8", "int": "<i4", "bigint": "<i8"}[kind]
    types = dict(df.dtypes)

    def split(chunk: pd.DataFrame) -> pd.DataFrame:
        raw = chunk.sort_values(order)[value].dropna().to_numpy(dtype).view(np.uint8).reshape(-1, int(dtype[-1]))
        out = pd.DataFrame({"stream": range(raw.shape[1]), "bytes": [raw[:, k].tobytes() for k in range(raw.shape[1])]})
        for c in reversed(list(within)):
            out.insert(0, c, chunk[c].iloc[0])
        return out

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in within), "stream int", "bytes binary"])
    return df.select(*within, order, value).groupBy(*within).applyInPandas(split, schema)


def byte_stream_join(streams: DataFrame, within: Sequence[str], kind: str = "double") -> DataFrame:
    """(within, pos, value) of split streams."""
    dtype = {"float": "<f4", "double": "<f8", "int": "<i4", "bigint": "<i8"}[kind]
    types = dict(streams.dtypes)

    def join(chunk: pd.DataFrame) -> pd.DataFrame:
        raw = np.stack([np.frombuffer(b, np.uint8) for b in chunk.sort_values("stream")["bytes"]], axis=1)
        out = pd.DataFrame({"pos": range(len(raw)), "value": np.ascontiguousarray(raw).view(dtype).ravel()})
        for c in reversed(list(within)):
            out.insert(0, c, chunk[c].iloc[0])
        return out

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in within), "pos long", f"value {kind}"])
    return streams.groupBy(*within).applyInPandas(join, schema)
