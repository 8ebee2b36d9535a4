"""CRC-32 and XXH64 of values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed-width kinds, as Parquet's plain encoding lays them out.
PLAIN = {"int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8"}

# The primes of the published hash.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def crc32(column: Column) -> Column:
    """CRC-32 (IEEE) of a string's or binary's bytes, as an unsigned value in a long."""
    return F.crc32(column.cast("binary"))


def _numbers(values: pa.Array, kind: str) -> np.ndarray:
    return values.fill_null(0).to_numpy(zero_copy_only=False).astype(PLAIN[kind])


def little_endian(column: Column, kind: str) -> Column:
    """The bytes of a value in plain encoding; kind: the column's Spark type."""
    if kind in ("string", "binary"):
        return column.cast("binary")

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        numbers = _numbers(values, kind)
        width = numbers.dtype.itemsize
        packed = pa.Array.from_buffers(pa.binary(width), len(numbers), [None, pa.py_buffer(numbers.tobytes())])
        return pc.if_else(values.is_null(), pa.scalar(None, pa.binary()), packed.cast(pa.binary()))

    return run(column)


def from_little_endian(column: Column) -> Column:
    """The number that eight bytes in plain encoding stand for, if it isn't negative."""
    octets = F.transform(F.sequence(F.lit(8), F.lit(1), F.lit(-1)), lambda k: F.hex(F.substring(column, k, F.lit(1))))
    return F.conv(F.array_join(octets, ""), 16, 10).cast("long")


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64_of_numbers(numbers: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each number's 4 or 8 bytes, for all of them at once."""
    width = numbers.dtype.itemsize
    h = np.full(len(numbers), (seed + int(P5) + width) % 2**64, np.uint64)
    if width == 8:
        h ^= _rotated(numbers.view("<u8") * P2, 31) * P1
        h = _rotated(h, 27) * P1 + P4
    else:
        h ^= numbers.view("<u4").astype(np.uint64) * P1
        h = _rotated(h, 23) * P2 + P3
    for shift, prime in ((33, P2), (29, P3)):
        h ^= h >> np.uint64(shift)
        h *= prime
    return h ^ (h >> np.uint64(32))


def xxh64(column: Column, kind: str, seed: int = 0) -> Column:
    """XXH64 of a value's plain-encoded bytes, as a signed long: with seed 0, the hash that Parquet's bloom filters use."""

    @F.arrow_udf("long")
    def run(values: pa.Array) -> pa.Array:
        if kind in PLAIN:
            hashes = xxh64_of_numbers(_numbers(values, kind), seed)
        else:
            hashes = np.array([xxhash.xxh64_intdigest(v, seed) if v is not None else 0 for v in values.to_pylist()], np.uint64)
        return pa.array(hashes.view(np.int64), mask=np.asarray(values.is_null()))

    return run(column if kind in PLAIN else column.cast("binary"))


def with_xxh64(df: DataFrame, column: str, name: str = "xxh64", seed: int = 0) -> DataFrame:
    """Adds XXH64 of a column."""
    return df.withColumn(name, xxh64(F.col(column), dict(df.dtypes)[column], seed))
