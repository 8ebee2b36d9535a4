"""SimHash near-dedup: fingerprints of word shingles, linked by tiled exact comparison.

Distinct fingerprints are dealt into tiles by the population counts of their segments (2, 4 or 8
equal parts of the 64 bits, more for more fingerprints). Fingerprints within the radius have
segment counts that differ by no more than the radius in all, so tile pairs beyond it are never
formed. Tiles larger than a block are split by hash. Each task compares one block of a tile with
one block of its neighbours by numpy exclusive-or and bit counts, again skipping sub-tiles by
their counts, and gives a spanning forest of the links it found, not the links. Spark joins make
components of the forests.

For similarity, not for a few bits, there are wide fingerprints (similar_documents): WIDE words of 64
bits over a text's set of five-word shingles. Two sets of similarity 0.8 differ in a share of the bits
that is known, and the radius is that share and SURE deviations, so that 99 in 100 such pairs are
within it. Tiles then hold sets of like size, as sets whose sizes differ by more can't be that similar;
every tile is compared with itself and the next, its first words first. Links are by the fingerprints'
radius, so some pairs of a similarity from 0.7 link too.

Defined results: a null text has no words; texts without words have fingerprint zero, which links
like any other; texts with fewer words than a shingle are one shingle; rows that repeat share
fingerprint and component; component_id is the smallest doc_id that is not null (null if there is
none); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

SEED = 42
CHUNK = 1 << 20  # bytes of a text whose shingles are in memory at once
SPACES = b" \t\n\x0b\x0c\r"


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: lowers A-Z, and split() splits at the six ASCII spaces
    counts, n, carry, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(raw) or not at:
        end = at + CHUNK
        while end < len(raw) and raw[end] not in SPACES:
            end += 1
        words = carry + raw[at:end].split()
        at = max(1, end)
        if at >= len(raw) and not n and 0 < len(words) < shingle:
            shingles = [b" ".join(words)]
        else:
            shingles = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
            carry = words[max(0, len(words) - shingle + 1) :] if shingle > 1 else []
        n += len(shingles)
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fps = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def merge_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after joining u[k] with v[k] for all k; equal labels are one component."""
    while True:
        apart = labels[u] != labels[v]
        u, v = u[apart], v[apart]
        if not len(u):
            return labels
        low = np.minimum(labels[u], labels[v])
        np.minimum.at(labels, labels[u], low)
        np.minimum.at(labels, labels[v], low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def segment_counts(fps: np.ndarray, segments: int) -> np.ndarray:
    width = 64 // segments
    mask = np.uint64((1 << width) - 1)
    return np.stack([np.bitwise_count((fps >> np.uint64(width * k)) & mask).astype(np.int16) for k in range(segments)], axis=1)


def forest(own: np.ndarray, others: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links that join own with others just as all pairs at `radius` or less do: a chain for each component."""
    nodes = np.unique(np.concatenate([own, others]))
    own, others = np.unique(own), np.unique(others)
    labels = np.arange(len(nodes))

    def tiles(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        counts = segment_counts(fps, 4)
        order = np.lexsort(counts.T[::-1])
        fps, counts = fps[order], counts[order]
        return [(f := fps[k : k + tile], np.searchsorted(nodes, f), counts[k : k + tile].min(0), counts[k : k + tile].max(0)) for k in range(0, len(fps), tile)]

    theirs = tiles(others)
    for a, at_a, low_a, high_a in tiles(own):
        for b, at_b, low_b, high_b in theirs:
            gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)).sum()
            if gap > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            labels = merge_labels(labels, at_a[i], at_b[j])
    order = np.argsort(labels, kind="stable")
    same = labels[order[1:]] == labels[order[:-1]]
    return nodes[order[:-1]][same], nodes[order[1:]][same]


def _segments(n: int) -> int:
    return 2 if n <= 500_000 else 4 if n <= 20_000_000 else 8


def links(fps: DataFrame, n: int, radius: int = 2, segments: int | None = None, block: int | None = None) -> DataFrame:
    """Forest links (a, b) between the n distinct fingerprints of fps(fp long) at `radius` or less."""
    segments = segments or _segments(n)
    block = block or min(4096, max(256, n // 128))
    width = 64 // segments
    base = width + 1 + 2 * radius  # neighbours' counts stay apart from the next segment's
    count = lambda k: F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit((1 << width) - 1)))
    tile = sum(((count(k) + radius) * F.lit(base**k) for k in range(1, segments)), (count(0) + radius) * F.lit(1)).cast("long")
    fps = fps.select("fp", tile.alias("tile"), F.xxhash64(F.lit(7), "fp").alias("h"))
    # Steps to neighbour tiles: of each pair of opposite steps, one.
    steps = [d for d in _steps(segments, radius) if next((x for x in d if x), 1) > 0]
    shifts = [sum(x * base**k for k, x in enumerate(d)) for d in steps]

    sizes = fps.groupBy("tile").agg(F.count(F.lit(1)).alias("own"))
    # What meets a tile comes from the tiles a step away.
    visits = sizes.select(F.explode(F.array([F.col("tile") - s for s in shifts])).alias("tile"), F.col("own").alias("visitors"))
    tiles = sizes.join(visits.groupBy("tile").agg(F.sum("visitors").alias("visitors")), "tile").select(
        "tile", F.ceil(F.col("own") / block).cast("int").alias("n_own"), F.ceil(F.col("visitors") / (4 * block)).cast("int").alias("n_visitors")
    )
    tiles = common.stage(tiles, "tiles")
    if segments <= 4:  # at most (64 / segments + 1) ** segments rows: 1,089 or 83,521
        tiles = F.broadcast(tiles)
    split = lambda h, parts: F.pmod(h, parts).cast("int")
    upto = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    owners = fps.join(tiles, "tile").select("tile", "fp", split(F.col("h"), F.col("n_own")).alias("i"), upto("n_visitors").alias("c"), F.lit(True).alias("own"))
    guests = fps.select("fp", "h", F.explode(F.array([F.col("tile") - s for s in shifts])).alias("tile")).join(tiles, "tile")
    guests = guests.select("tile", "fp", upto("n_own").alias("i"), split(F.xxhash64(F.lit(8), "h"), F.col("n_visitors")).alias("c"), F.lit(False).alias("own"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp, own = group["fp"].to_numpy(np.int64).view(np.uint64), group["own"].to_numpy(bool)
        a, b = forest(fp[own], fp[~own], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return owners.unionByName(guests).groupBy("tile", "i", "c").applyInPandas(compare, "a long, b long")


def _steps(segments: int, radius: int) -> list[tuple[int, ...]]:
    """Integer vectors whose absolute values sum to the radius at most."""
    found = [()]
    for _ in range(segments):
        found = [(*d, x) for d in found for x in range(-radius, radius + 1) if sum(map(abs, d)) + abs(x) <= radius]
    return found


#: Words of 64 bits in a wide fingerprint; the similarity that its radius is for; deviations that the radius adds.
WIDE, SIMILAR, SURE = 16, 0.8, 2.33
FACTORS, SALTS = (np.array([xxhash.xxh64_intdigest(bytes([k, tag]), SEED) | 1 for k in range(64)], np.uint64) for tag in range(2))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of a text's runs of words, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    runs = max(1, len(words) - shingle + 1)
    out = np.full(runs, min(len(words), shingle), np.uint64)
    for k in range(min(len(words), shingle)):
        out += h[k : k + runs] * FACTORS[k]
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    return np.unique(out)


def wide_fingerprint(hashes: np.ndarray, words: int = WIDE) -> bytes:
    """64 * words bits: each is set if its hash is in over half of the set."""
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 bits fit a byte
        x = hashes[at : at + 255, None] ^ SALTS[:words]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """doc_id, fp (a 64-bit number of the fingerprint and the size), n (the set's size), sketch (the fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
                n, wide = [len(s) for s in sets], [wide_fingerprint(s, words) for s in sets]
                fp = np.array([xxhash.xxh3_64_intdigest(w + k.to_bytes(8, "little"), SEED) for w, k in zip(wide, n)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), pa.array(n, pa.int64()), pa.array(wide, pa.binary())], ["doc_id", "fp", "n", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long, n long, sketch binary")


SMALL = 64  # sets of fewer hashes have radii of their own


def differing_share(a: int, b: int, similar: float = SIMILAR) -> float:
    """The share of bits in which sets of a and b hashes differ if their similarity is `similar` (the least whole overlap of that or more)."""
    shared = math.ceil(similar / (1 + similar) * (a + b) - 1e-9)
    if a + b > 4 * SMALL:
        return math.acos(min(1.0, shared / math.sqrt(a * b))) / math.pi
    coins = lambda n: np.array([math.comb(n, k) / 2**n for k in range(n + 1)])
    set_bits = np.arange(shared + 1)  # of the hashes that both have

    def over(n: int) -> np.ndarray:
        """The chance of a bit in the fingerprint of n hashes, for each number of set bits among the shared ones."""
        own = coins(n - shared)
        return ((2 * (np.arange(len(own))[None, :] + set_bits[:, None]) > n) * own).sum(axis=1)

    x, y = over(a), over(b)
    return float((coins(shared) * (x * (1 - y) + y * (1 - x))).sum())


@lru_cache(maxsize=8)
def radii(bits: int, similar: float = SIMILAR) -> np.ndarray:
    """The radius for sets of k hashes and their partners of k or more, for k under SMALL; the last is for all larger ones."""
    out = np.full(SMALL + 1, -1.0)
    for k in range(1, SMALL + 1):
        sizes = range(k, int(k / similar + 1e-9) + 1) if k < SMALL else (100 * SMALL,)
        share = max(differing_share(k if k < SMALL else b, b, similar) for b in sizes)
        out[k] = bits * share + SURE * math.sqrt(bits * share * (1 - share))
    out[SMALL] = max(out[SMALL], out[SMALL // 2 : SMALL].max())
    return out


def similar_forest(n: np.ndarray, sketches: np.ndarray, side: np.ndarray, similar: float = SIMILAR, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links that join rows just as all pairs of a row of side 0 with one of side 1 (all rows, if there is one side) within the radius do."""
    order = np.argsort(n, kind="stable")
    n, sketches, side = n[order], sketches[order], side[order]
    counts = np.bitwise_count(sketches[:, 0]).astype(np.int16)
    whole, first = radii(64 * sketches.shape[1], similar), radii(64, similar)
    labels = np.arange(len(n))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = not len(left) or not len(right)
    left, right = (np.arange(len(n)),) * 2 if same else (left, right)
    cut = lambda places: [places[k : k + tile] for k in range(0, len(places), tile)]
    for x in cut(left):
        reach = first[min(n[x].min(), SMALL) :].max()
        for y in cut(right):
            if same and y[0] < x[0] or similar * n[y[0]] > n[x[-1]] or similar * n[x[0]] > n[y[-1]]:
                continue
            if max(counts[x].min() - counts[y].max(), counts[y].min() - counts[x].max()) > reach:
                continue
            off = np.bitwise_count(sketches[x, 0][:, None] ^ sketches[None, y, 0])
            at = np.flatnonzero(off <= reach)
            i, j, off = x[at // len(y)], y[at % len(y)], off.ravel()[at].astype(np.int64)
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            near = (i != j) & (low >= similar * high - 1e-9) & (off <= first[np.minimum(low, SMALL)])
            i, j, off, low = i[near], j[near], off[near], low[near]
            for w in range(1, sketches.shape[1]):
                off += np.bitwise_count(sketches[i, w] ^ sketches[j, w])
                if w % 4 == 3:
                    near = off <= whole[np.minimum(low, SMALL)]
                    i, j, off, low = i[near], j[near], off[near], low[near]
            near = off <= whole[np.minimum(low, SMALL)]
            labels = merge_labels(labels, i[near], j[near])
    chain = np.argsort(labels, kind="stable")
    joined = labels[chain[1:]] == labels[chain[:-1]]
    return order[chain[:-1][joined]], order[chain[1:][joined]]


def similar_links(groups: DataFrame, total: int, similar: float = SIMILAR, block: int | None = None) -> DataFrame:
    """Forest links (a, b) between the distinct fingerprints of groups(fp, n, sketch) that are within the radius."""
    block = block or min(1 << 16, max(2048, total // 64))
    # Below this size sets are similar only if they are equal.
    groups = groups.filter(F.col("n") >= math.ceil(similar / (1 - similar) - 1e-9))
    groups = groups.withColumn("tile", F.floor(F.log(F.col("n").cast("double")) / math.log(1 / similar)).cast("int")).withColumn("h", F.xxhash64(F.lit(9), "fp"))
    sizes = common.stage(groups.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts")), "tiles")  # a row for each power of 1 / similar
    beside = lambda step, name: F.broadcast(sizes.select((F.col("tile") - step).alias("tile"), F.col("parts").alias(name)))
    placed = groups.join(F.broadcast(sizes), "tile").join(beside(1, "above"), "tile", "left").join(beside(-1, "below"), "tile", "left")
    placed = placed.withColumn("part", F.pmod("h", F.col("parts")).cast("int"))
    none = F.array().cast("array<struct<tile: int, own: boolean, i: int, j: int, side: int>>")
    task = lambda tile, own, i, j, side: F.struct(tile.cast("int").alias("tile"), F.lit(own).alias("own"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # Blocks of one tile meet in pairs; a block alone meets itself, with one side only.
    within = F.transform(upto("parts"), lambda q: task(F.col("tile"), True, F.least(F.col("part"), q), F.greatest(F.col("part"), q), (F.col("part") > q).cast("int")))
    upper = F.when(F.col("above").isNotNull(), F.transform(upto("above"), lambda q: task(F.col("tile"), False, F.col("part"), q, F.lit(0)))).otherwise(none)
    lower = F.when(F.col("below").isNotNull(), F.transform(upto("below"), lambda q: task(F.col("tile") - 1, False, q, F.col("part"), F.lit(1)))).otherwise(none)
    rows = placed.select("fp", "n", "sketch", F.explode(F.concat(within, upper, lower)).alias("t")).select("t.*", "fp", "n", "sketch")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        wide = np.frombuffer(b"".join(group["sketch"]), "<u8").reshape(len(group), -1)
        side = group["side"].to_numpy(np.int64)
        if not group["own"].iloc[0] and side.min() == side.max():
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        fp = group["fp"].to_numpy(np.int64)
        a, b = similar_forest(group["n"].to_numpy(np.int64), wide, side, similar)
        return pd.DataFrame({"a": fp[a], "b": fp[b]})

    return rows.groupBy("tile", "own", "i", "j").applyInPandas(compare, "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similar: float = SIMILAR, words: int = WIDE, block: int | None = None) -> DataFrame:
    """doc_id, fingerprint (the wide one's number, 16 hex digits), component_id: one row for each row of docs."""
    rows = common.stage(wide_fingerprints(docs, id_col, text_col, shingle, words), "wide_fingerprints")
    distinct = rows.groupBy("fp").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    return components_of(rows.select("doc_id", "fp"), lambda groups: similar_links(common.stage(distinct, "sketches"), groups.count(), similar, block))


def group_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, segments: int | None = None, block: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs."""
    rows = common.stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return components_of(rows, lambda groups: links(groups.select("fp"), groups.count(), radius, segments, block))


def components_of(rows: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, fingerprint, component_id for each row (doc_id, fp); linked gives the links between the groups of equal fp."""
    groups = common.stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "groups")
    found = common.stage(linked(groups), "found")
    members = common.stage(components.connected(found).withColumnRenamed("node", "fp").join(groups, "fp").select("fp", "root", "least_id"), "members")
    heads = common.stage(members.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "heads")
    named = common.join_hot(members.select("fp", "root"), heads, "root", "size", members.count()).select("fp", "component_id")
    named = common.stage(groups.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least_id").alias("component_id")), "named")
    out = common.join_hot(rows, named, "fp", "n", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of docs that stand for their component of fingerprints, with all their columns."""
    return keep_heads(docs, group_documents(docs, id_col, text_col, **options), id_col)


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stand for their component of similar texts, with all their columns."""
    return keep_heads(docs, similar_documents(docs, id_col, text_col, **options), id_col)


def keep_heads(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose doc_id is its component_id in groups; rows with a null doc_id, which no component is named by, stay too."""
    name = common.unused(docs, "_drop_id")
    drops = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    ident = F.col(id_col).cast("long")
    return docs.filter(ident.isNotNull()).join(drops, ident == F.col(name), "left_anti").unionAll(docs.filter(ident.isNull()))
