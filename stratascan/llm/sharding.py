"""Balanced label propagation: linked documents move towards their neighbours' shards, shard sizes stay even.

Documents with equal texts are linked. Copies of a text have the same neighbours and are
interchangeable, so the state is one row for each text and shard: how many of its copies lie there.
Linked documents start spread evenly. In each round a join of that table with each text's votes
(its copies in every shard) sends copies towards the shard with most of them, ties by hash; moves
between two shards are then granted in order of gain, up to quotas that keep each shard within its
capacity, which the driver works out from the demand for each pair of shards. A shard that had to
refuse copies is not asked again for some rounds, so the rest of a text too large for one shard
gathers in another. Rounds go on until, for as many as there are shards, none joins more copies of a
text than were joined before. Documents without links fill what room is left.

The law is `rows`: shards' row counts differ by one at most. Only tables of shards x shards numbers
are on the driver.

Defined results: a null text counts as empty, with size 1; empty texts are linked like any other;
rows that repeat are linked copies; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def quotas(demand: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The largest part of the demand (from x to) that the joins of this scheme grant: no shard gains more than its room."""
    grant = demand.astype(np.int64).copy()
    while True:
        over = grant.sum(0) - grant.sum(1) - room
        j = int(np.argmax(over))
        if over[j] <= 0:
            return grant
        # The excess and no more, in proportion: what is cut here is excess where it came from, so rounding up would spread.
        into, excess = grant[:, j], min(over[j], grant[:, j].sum())
        cut, rest = np.divmod(into * excess, max(1, into.sum()))
        more = np.argsort(-rest, kind="stable")[: excess - cut.sum()]
        cut[more] += 1
        grant[:, j] = into - cut


def propagate(cells: DataFrame, shards: int, capacity: np.ndarray) -> DataFrame:
    """cells(group, shard, n): where each group's rows lie; gives the same when no round joins more copies. Row counts never pass capacity."""
    until = [0] * shards  # the round from which a shard that had to refuse may be asked again
    most, stale = -1.0, 0
    for at in itertools.count():
        used, joined = np.zeros(shards, np.int64), 0.0
        for r in cells.groupBy("shard").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("joined")).collect():
            used[r.shard] = r.n
            joined += r.joined
        # Links within shards grow with the sum of squares. Ties rotate, and shards that refused are asked again, within `shards` rounds: if none of these gains, none will.
        most, stale = (joined, 0) if joined > most else (most, stale + 1)
        if stale > shards:
            break
        room = capacity - used
        votes = cells.groupBy("group").agg(F.array(*[F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)) for s in range(shards)]).alias("votes"))
        # A shard's standing for a group: its copies there, then a rotation that its hash and the round fix, as full shards can only swap, and what one order doesn't pair another does.
        standing = lambda s: F.struct(F.get("votes", F.lit(s)).alias("n"), F.pmod(F.xxhash64("group", F.lit(at)) + s, F.lit(shards)).alias("tie"), F.lit(s).alias("shard"))
        if min(until) > at:  # all refused: what they did grant has changed the votes, so all are asked again
            until = [0] * shards
        open_shards = [s for s in range(shards) if until[s] <= at]
        votes = votes.select("group", F.array_max(F.array(*[standing(s) for s in open_shards])).alias("best"))
        own = F.struct(F.col("n"), F.pmod(F.xxhash64("group", F.lit(at)) + F.col("shard"), F.lit(shards)).alias("tie"), F.col("shard"))
        asks = cells.join(votes, "group").filter(F.col("best") > own)
        asks = common.stage(asks.select("group", "shard", "n", F.col("best.shard").alias("to"), (F.col("best.n") - F.col("n")).alias("gain")), "asks")
        demand = np.zeros((shards, shards), np.int64)
        for r in asks.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():
            demand[r.shard, r.to] = r.n
        grant = quotas(demand, room)
        for j in np.nonzero(grant.sum(0) < demand.sum(0))[0]:
            until[j] = at + shards
        if not grant.sum():
            common.drop(asks)
            if not demand.sum() and len(open_shards) == shards:
                break
            if len(open_shards) < shards:
                until = [0] * shards
            continue
        pairs = [(i, j, int(grant[i, j])) for i in range(shards) for j in range(shards) if grant[i, j]]
        limit = F.broadcast(cells.sparkSession.createDataFrame(pairs, "shard int, to int, quota long"))  # shards x shards rows at most
        # Larger gains first: by their power of two, then by hash.
        level = 63 - F.floor(F.log2(F.col("gain") + 1))
        asked, asks = asks, asks.join(limit, ["shard", "to"]).withColumn("h", F.xxhash64("group", "shard"))
        asks = common.prefixed(asks, ["shard", "to"], level * 64 + F.pmod("h", F.lit(64)), ["h", "group"], "n", "before")
        asks = asks.withColumn("go", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("before"))).cast("long")).filter("go > 0")
        moves = asks.select("group", F.explode(F.array(F.struct(F.col("shard"), (-F.col("go")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("go").alias("n")))).alias("m")).select("group", "m.*")
        last, cells = cells, common.stage(cells.unionByName(moves).groupBy("group", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "cells")
        common.drop(last, asked)
    return cells


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, and group_size."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"))
    rows = common.stage(rows, "rows")
    total = rows.count()
    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("copies"))
    rows = common.stage(common.join_hot(rows, common.stage(groups, "groups"), "group", "copies", total), "sized")
    linked, single = rows.filter("copies > 1"), rows.filter("copies = 1")
    capacity = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)

    linked = common.stage(common.ranked(linked, [], ["doc_id", "group"], "place"), "linked")
    start = linked.groupBy("group", F.pmod("place", F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    cells = propagate(common.stage(start, "cells"), shards, capacity)

    # Copies of a group go to its cells in order of their rank.
    ends = cells.withColumn("end", F.sum("n").over(Window.partitionBy("group").orderBy("shard")))
    ends = ends.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends"), F.sum("n").alias("n"))
    inside = common.stage(common.ranked(linked, ["group"], ["doc_id"], "turn"), "inside")
    put = common.join_hot(inside, common.stage(ends, "ends"), "group", "n", total)
    put = put.withColumn("shard", F.filter("ends", lambda e: e["end"] > F.col("turn"))[0]["shard"])

    used = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    full = np.cumsum([capacity[s] - used.get(s, 0) for s in range(shards)])
    single = common.ranked(single, [], ["doc_id", "group"], "turn", salt=1)
    into = reduce(lambda acc, s: F.when(F.col("turn") < int(full[s]), F.lit(s)).otherwise(acc), reversed(range(shards)), F.lit(shards - 1))
    cols = ["doc_id", "size", "text_crc32", "group", "copies", "shard"]
    out = put.select(*cols).unionByName(single.withColumn("shard", into).select(*cols))
    out = common.ranked(common.stage(out, "put"), ["shard"], ["doc_id", "group"], "slot", salt=2)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("copies").alias("group_size"))
