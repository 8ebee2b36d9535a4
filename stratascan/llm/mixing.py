"""Mixing sources to target weights with exact block quotas.

Each source's documents lie in one stream, in an order that hashes of their ids fix; a target above
the source's size runs through the stream again. All targets together are cut into as many blocks a
shard as asked for, of one size for all sources as nearly as whole blocks allow, so a source's quota
of blocks is in proportion to its target. A splitting tree halves the output shards and draws how
many blocks of each source go left, from the multivariate hypergeometric distribution, down to
single shards, whose numbers of blocks differ by one at most. Each shard then has disjoint blocks of
a permutation of each source's blocks, and is shuffled by itself. A document that lies over the
border of two blocks is in both, with its words up to the border and those beyond.

Only a table of sources (MOST_SOURCES at most, or an error) and a shard number for each block are on
the driver. Positions in streams are prefix sums in two steps, so a source with most rows is not in
one task; rows that repeat in full a thousandth of all rows' times or more are drawn as one row with
a number, so they aren't in one task either (where such rows differ in other columns, one stands for
all).

Defined results: a null text has no words and is not taken; a null source is a source of its own,
after all others; rows that repeat are taken each; without words all targets are 0; an empty table
gives no rows. A document at the end of a target may be taken in part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MOST_SOURCES = 100_000
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: list[int], weights: list[float], share: float = 1.0, most: float = 3.0) -> list[float]:
    """Words of each source: `share` of all words by weight, none above `most` times its size; what is above is shared again by weight."""
    left, out = float(sum(sizes)) * share, [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        each = left / sum(weights[k] for k in free)
        full = [k for k in free if weights[k] * each > most * sizes[k]]
        for k in full or free:
            out[k] = most * sizes[k] if full else weights[k] * each
        if not full:
            break
        left -= sum(out[k] for k in full)
        free -= set(full)
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources): rows sum to equal numbers, columns to the quotas."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    draw = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals")
    return np.vstack([split_quotas(draw, left, rng), split_quotas(quotas - draw, shards - left, rng)])


def _row_key(id_col: str, text_col: str, source_col: str) -> Column:
    """A string that rows share only if they agree in id, source and text (its CRC and length)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    null_or = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return F.concat_ws("|", F.crc32(text.cast("binary")), F.octet_length(text), null_or(id_col), null_or(source_col))


def block_quotas(words: list[int], blocks: int) -> np.ndarray:
    """Blocks of each source: in proportion to its words, one at least if it has any, `blocks` in all or so."""
    size = max(1.0, sum(words) / max(1, blocks))
    return np.array([min(w, max(1, round(w / size))) for w in words], np.int64)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, shards: int = 8, blocks: int = 256, seed: int = 17) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, copies, row_key.

    copies: array of (epoch int, words long, block int, shard int), one for each time and block that the mix takes
    words of the document for, in order; the weights repeat over the sources in code point order;
    blocks: a shard's number of them. Rows that share row_key agree in id, source and text.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(common.words(F.col(text_col).cast("string"))).cast("long").alias("size"), _row_key(id_col, text_col, source_col).alias("row_key")
    )
    rows = common.stage(rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))), "sizes")
    found = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source))
    target = targets([r.source_size for r in found], [weights[k % len(weights)] for k in range(len(found))], most=most)
    words = [min(round(t), int(most * r.source_size)) for t, r in zip(target, found)]
    quotas = block_quotas(words, shards * blocks)
    rng = np.random.default_rng(seed)
    parts = split_quotas(quotas, shards, rng)
    table = pd.DataFrame(
        {
            "key": [r.key for r in found], "n": [r.n for r in found], "source_size": [r.source_size for r in found], "target": target, "words": words, "quota": quotas,
            "shards": [rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), parts[:, k])).tolist() for k in range(len(found))],
        }
    )
    sources = docs.sparkSession.createDataFrame(table, "key string, n long, source_size long, target double, words long, quota long, shards array<int>")

    h = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size"))
    placed = common.prefixed(h, ["key"], F.pmod("h", F.lit(common.BUCKETS)), ["h", "doc_id", "size"], "size", "start")
    placed = common.stage(placed.drop("h"), "placed")
    out = common.join_hot(placed, sources, "key", "n", sum(r.n for r in found))

    # Block j has the words from floor(j * words / quota) up to that of j + 1.
    whole = lambda a, b: F.call_function("div", a, b)  # of whole numbers, exact
    border = lambda j: whole(j * F.col("words"), F.col("quota"))

    def copy(epoch):
        at = epoch * F.col("source_size") + F.col("start")
        end = F.least(at + F.col("size"), F.col("words"))
        block_of = lambda x: whole((x + 1) * F.col("quota") - 1, F.col("words"))
        segment = lambda j: F.struct(epoch.cast("int").alias("epoch"), (F.least(end, border(j + 1)) - F.greatest(at, border(j))).cast("long").alias("words"), j.cast("int").alias("block"), F.get("shards", j.cast("int")).alias("shard"))
        none = F.array().cast("array<struct<epoch: int, words: bigint, block: int, shard: int>>")
        return F.when(end > at, F.transform(F.sequence(block_of(at), block_of(end - 1)), segment)).otherwise(none)

    epochs = F.flatten(F.array(*[copy(F.lit(e).cast("long")) for e in range(int(np.ceil(most)))]))
    out = out.withColumn("copies", epochs)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda acc, c: acc + c["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", "row_key")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, most: float = 3.0, **options) -> DataFrame:
    """The mix itself: rows of docs with all their columns, once for each time that the mix takes them, dealt to shards and shuffled there.

    Documents are whole here: one that is taken in part comes if that is half of it or more, and goes
    to the shard that has most of it. Rows that agree in id, source and text are interchangeable, so
    each gets the copies of one of them.
    """

    def once(epoch: int) -> Column:
        own = F.filter("copies", lambda c: c["epoch"] == epoch)
        words = F.aggregate(own, F.lit(0).cast("long"), lambda acc, c: acc + c["words"])
        largest = F.array_max(F.transform(own, lambda c: F.struct(c["words"].alias("words"), (-c["block"]).alias("block"), c["shard"].alias("shard"))))
        return F.when((words > 0) & (2 * words >= F.col("size")), F.struct(F.lit(epoch).alias("epoch"), largest["shard"].alias("shard")))

    comes = F.array_compact(F.array(*[once(e) for e in range(int(np.ceil(most)))]))
    took = common.stage(plan(docs, id_col, text_col, source_col, seed=seed, most=most, **options).select("row_key", comes.alias("copies")), "took")
    often = took.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2, int(took.count() * common.HOT_SHARE))).select("row_key")
    often = F.broadcast(common.stage(often, "often"))  # 1 / HOT_SHARE rows at most
    hot = not often.isEmpty()
    tagged = docs.select(F.struct(*common.columns(docs)).alias("row"), _row_key(id_col, text_col, source_col).alias("row_key"), F.col(id_col).cast("string").alias("id"))
    some, some_took = (tagged.join(often, "row_key", "left_anti"), took.join(often, "row_key", "left_anti")) if hot else (tagged, took)
    lists = some_took.groupBy("row_key").agg(F.sort_array(F.collect_list("copies")).alias("all_copies"))  # one list for each row that repeats
    some = some.withColumn("turn", F.row_number().over(Window.partitionBy("row_key").orderBy("row_key")) - 1)
    out = some.join(lists, "row_key").select("row", "id", F.explode(F.get("all_copies", F.col("turn"))).alias("c")).select("row", "id", "c.shard", F.col("c.epoch").cast("long").alias("nth"))
    if hot:
        wanted = took.join(often, "row_key", "left_semi").select("row_key", F.explode("copies").alias("c")).groupBy("row_key", "c.shard").agg(F.count(F.lit(1)).alias("n"))
        one = tagged.join(often, "row_key", "left_semi").groupBy("row_key").agg(F.first("row").alias("row"), F.first("id").alias("id"))
        # In lots of 1,000, which are dealt before they become rows.
        lots = one.join(F.broadcast(wanted), "row_key").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(1000).cast("long")))).repartition("row_key", "shard", "lot")
        out = out.unionByName(lots.select("row", "id", "shard", F.explode(F.sequence(F.col("lot"), F.least(F.col("lot") + 999, F.col("n") - 1))).alias("nth")))
    place = F.xxhash64(F.lit(seed), "id", "nth")
    return out.repartition("shard", F.pmod(place, F.lit(1 << 16))).sortWithinPartitions("shard", place).select("row.*")
