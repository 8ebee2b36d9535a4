"""Split-block bloom filters as frames: a row for each 32-bit word that has bits.

The layout is that of the Parquet specification: blocks of eight words, one bit in each word for a
value, the block by multiply-shift of the hash's upper half, the bits by the lower half and eight
salts. Building and merging are aggregates by bit_or, so they combine before the shuffle; checking
is a join on the block.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ScanError, Status
from . import hashing

# The salts of the published format.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
LOW32 = 0xFFFFFFFF


def blocks_for(ndv: int, fpp: float = 0.01) -> int:
    """Blocks of 32 bytes for a number of distinct values and a share of false positives."""
    if ndv < 1 or not 0 < fpp < 1:
        raise ScanError(Status.INVALID_ARGUMENT, "ndv has to be positive, fpp between 0 and 1")
    return max(1, math.ceil(-ndv * math.log(fpp) / math.log(2) ** 2 / 256))


def blocks_in(size: int) -> int:
    """Blocks of a filter of so many bytes: whole blocks that hold them, one at least."""
    if size < 0:
        raise ScanError(Status.INVALID_ARGUMENT, "a size isn't negative")
    return max(1, -(-size // 32))


def block_of(h: Column, blocks: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(h, 32) * F.lit(blocks), 32)


def words_of(h: Column) -> Column:
    """Array of (word, mask): the bit that a hash has in each word of its block."""
    low = h.bitwiseAND(F.lit(LOW32))

    def mask(salt: int) -> Column:
        # The product modulo 2^32 by halves of the salt, so that no step leaves 63 bits.
        upper = F.shiftleft((low * F.lit(salt >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
        product = (low * F.lit(salt & 0xFFFF) + upper).bitwiseAND(F.lit(LOW32))
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(product, 27).cast("int"))

    return F.array(*[F.struct(F.lit(k).alias("word"), mask(s).alias("mask")) for k, s in enumerate(SALTS)])


def build(df: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, word, bits) of the filter of a column's values; nulls aren't in it."""
    # Nulls go before hashing: a filter on the hash would make Spark compute it twice.
    return from_hashes(hashing.with_xxh64(df.select(column).filter(F.col(column).isNotNull()), column, "h"), "h", blocks)


def from_hashes(df: DataFrame, hash_column: str, blocks: int) -> DataFrame:
    """(block, word, bits) of the filter of hashes, none of them null."""
    h = F.col(hash_column)
    bits = df.select(block_of(h, blocks).alias("block"), F.explode(words_of(h)).alias("w"))
    return bits.groupBy("block", "w.word").agg(F.bit_or("w.mask").alias("bits"))


#: Blocks of a filter that is broadcast: 32 bytes each, and some ten times that as rows.
FEW_BLOCKS = 1 << 16


def check(df: DataFrame, column: str, bloom: DataFrame, blocks: int, name: str = "might_contain") -> DataFrame:
    """df with a boolean: false only if the value isn't in the filter; null for null. One join by block: with FEW_BLOCKS or less by broadcast, else by shuffle."""
    h = F.col("_h")
    own = hashing.with_xxh64(df, column, "_h").withColumn("_block", block_of(h, blocks))
    by_block = bloom.groupBy(F.col("block").alias("_b")).agg(*[F.max(F.when(F.col("word") == k, F.col("bits"))).alias(f"_w{k}") for k in range(len(SALTS))])
    by_block = F.broadcast(by_block) if blocks <= FEW_BLOCKS else by_block.hint("merge")
    joined = own.join(by_block, F.col("_block") == F.col("_b"), "left")
    all_set = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_w{k}").bitwiseAND(w) != 0, F.lit(False)) for k, w in ((k, words_of(h)[k]["mask"]) for k in range(len(SALTS)))])
    return joined.withColumn(name, F.when(h.isNotNull(), all_set)).select(*df.columns, name)


def merge(*filters: DataFrame) -> DataFrame:
    """The filter of all their values; the filters have to have the same number of blocks."""
    both = filters[0]
    for f in filters[1:]:
        both = both.unionByName(f)
    return both.groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))


def to_bytes(bloom: DataFrame, blocks: int) -> bytes:
    """The filter's bytes as a file holds them: little-endian words. For filters that fit the driver, as files' do."""
    out = bytearray(32 * blocks)
    for r in bloom.collect():
        at = 32 * r.block + 4 * r.word
        out[at : at + 4] = r.bits.to_bytes(4, "little")
    return bytes(out)


def from_bytes(spark, raw: bytes) -> DataFrame:
    """(block, word, bits) of a filter's bytes."""
    if not raw or len(raw) % 32:
        raise ScanError(Status.INVALID_ARGUMENT, "a filter's bytes come in blocks of 32")
    words = [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)]
    return spark.createDataFrame([(k // 8, k % 8, w) for k, w in enumerate(words) if w], "block long, word int, bits long")
