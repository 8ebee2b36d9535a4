"""Substring dedup by hashing lines, and runs of sentences.

Units are lines with `least_line` words or more (0: all that aren't blank; LEAST_WORDS if not given;
lines without words are compared by their marks), and, from each sentence start, the shortest run of
sentences that has LEAST_WORDS; runs go on over line ends. Sentences of more than LONG_SENTENCE words
are cut after words whose hash is a multiple of CUT, so that equal passages in them are cut alike.
A unit is normalised (lower case, letters and digits only, one space between words) and hashed;
digests are grouped over all documents, the occurrence that ranks first (by doc_id, then offset)
stays, and all others are repeats, with their offsets in the original text. A passage that was
pasted into the middle of a line is found by its inner sentences.

Only digests and offsets are shuffled for that, once: in the order of doc_id and offset, what isn't
a digest's first is a repeat. Digests with many occurrences don't go that way: they are told by a
sketch, grouped where they lie, and joined by broadcast. Then each document's spans are put together,
and what documents lose is cut from them.

Defined results: a null text has no units; what is shorter than a unit is left alone; a null doc_id
ranks first; rows that agree in doc_id and text are one document, so they aren't repeats of each
other, and each has its repeats of others; rows of one doc_id and different texts are documents of
their own, ranked by the texts' hashes where doc_id and offset are equal; a unit that occurs twice in
one document is a repeat; an empty table gives no rows. Offsets are in code points, the end exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST_WORDS, LONG_SENTENCE, CUT = 8, 24, 8
SENTENCE = re.compile(r"[^.!?。！？]+[.!?。！？]*")
WORD = re.compile(r"\w+")
KINDS = ("line", "sentences")
UNITS, CUT_TEXT = "_units_of_repeats", "_text_without_repeats"  # columns while texts are cut
MARKS = "\0"  # before a line without words, which is equal to lines of the same marks


def lowered(text: str) -> str:
    """The text in lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def pieces(line: str, at: int) -> list[tuple[int, int, int, str]]:
    """(start, end, number of words, words joined) of the sentences of a line that have words, long ones cut; the line starts at `at`."""
    out = []
    for m in SENTENCE.finditer(line):
        part = m.group()
        words = WORD.findall(part)
        begin, end = at + m.end() - len(part.lstrip()), at + m.start() + len(part.rstrip())
        if len(words) <= LONG_SENTENCE:
            if words:
                out.append((begin, end, len(words), " ".join(words)))
            continue
        own: list[str] = []
        first = None
        for w in WORD.finditer(part):
            first = w.start() if first is None else first
            own.append(w.group())
            if zlib.crc32(own[-1].encode("utf-8", "surrogatepass")) % CUT == 0:
                out.append((at + m.start() + first, at + m.start() + w.end(), len(own), " ".join(own)))
                own, first = [], None
        if own:
            out.append((at + m.start() + first, end, len(own), " ".join(own)))
    return out


def units(text: str | None, least: int = LEAST_WORDS, least_line: int | None = None) -> list[tuple[int, int, int, int, str]]:
    """(kind, start, end, number of words, normalised text) of each unit of a text; kind: place in KINDS."""
    least_line = least if least_line is None else least_line
    out, found, lines, at = [], [], set(), 0
    for line in lowered(text or "").split("\n"):
        own = pieces(line, at)
        n = sum([p[2] for p in own])
        if n >= least_line and line.strip():
            span = (at + len(line) - len(line.lstrip()), at + len(line.rstrip()))
            lines.add(span)
            out.append((0, *span, n, " ".join([p[3] for p in own]) or MARKS + " ".join(line.split())))
        found += own
        at += len(line) + 1
    j, n = 0, 0  # the run that starts at i ends before j and has n words
    for i, (begin, _, size, joined) in enumerate(found):
        while j < len(found) and n < least:
            n += found[j][2]
            j += 1
        if n < least:
            break
        if (begin, found[j - 1][1]) not in lines:
            out.append((1, begin, found[j - 1][1], n, joined if j == i + 1 else " ".join([p[3] for p in found[i:j]])))
        n -= size
    return out


SCHEMA = "doc_id long, text_key long, d1 long, d2 long, span long, size int"


def _key(text_col: str) -> Column:
    """What tells a document's text from others of its doc_id."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def all_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, least_line: int | None = None) -> DataFrame:
    """A narrow row for each unit: 128 bits of digest, start and end in one long, words and kind in one int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh3_128_digest
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [units(t, least, least_line) for t in part.column(2).to_pylist()]
                rows = [u for us in found for u in us]
                kind, start, end, n = (np.array([u[k] for u in rows], np.int64) for k in range(4))
                halves = np.frombuffer(b"".join([hashed(u[4].encode("utf-8", "surrogatepass")) for u in rows]), "<i8").reshape(-1, 2)
                of = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array((start << 32) | end), pa.array((2 * n + kind).astype(np.int32))], ["doc_id", "text_key", "d1", "d2", "span", "size"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, SCHEMA)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, least_line: int | None = None) -> DataFrame:
    """One row for each repeat: doc_id, text_key, unit, start, end, n_words, digest (hex), kept_doc_id, kept_start.

    kept_doc_id and kept_start name the occurrence that stays; text_key, a hash of the document's
    text, tells documents of one doc_id apart.
    """
    start = lambda span: F.shiftright(span, 32).cast("int")
    found = common.stage(all_units(docs, id_col, text_col, least, least_line), "units")
    place = F.struct("doc_id", "span", "text_key")  # starts order as spans do, up to the end
    often = found.filter(F.col("d1").isin(common.hot_values(found, "d1")))
    firsts = F.broadcast(common.stage(often.groupBy("d1", "d2").agg(F.min(place).alias("first")), "firsts"))  # as many as hot values, but for digests that agree by half
    out = found.join(firsts, ["d1", "d2"], "left")
    # What a hot digest has is known by now, so its rows are spread; the others of a digest meet, in order.
    spread = F.when(F.col("first").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("text_key", "span"), F.lit(4096)))
    order = Window.partitionBy("d1", "d2", "spread").orderBy("doc_id", "span", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("spread", spread).withColumn("kept", F.coalesce("first", F.first(place).over(order)))
    kept = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_key") == F.col("kept.text_key")) & (start(F.col("span")) == start(F.col("kept.span")))
    return out.filter(~kept).select(
        "doc_id", "text_key", F.when(F.col("size") % 2 == 0, F.lit(KINDS[0])).otherwise(F.lit(KINDS[1])).alias("unit"), start(F.col("span")).alias("start"), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("end"),
        F.shiftright("size", 1).alias("n_words"), F.lower(F.concat(F.lpad(F.hex("d1"), 16, "0"), F.lpad(F.hex("d2"), 16, "0"))).alias("digest"), F.col("kept.doc_id").alias("kept_doc_id"), start(F.col("kept.span")).alias("kept_start"),
    )


def removals(repeats: DataFrame) -> DataFrame:
    """A row for each document with repeats: doc_id, text_key, copies (rows that are this document), units (its repeats in order)."""
    unit = F.struct("start", "end", "unit", "kept_doc_id", "kept_start")
    out = repeats.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(unit)).alias("units"))
    return out.select("doc_id", "text_key", (F.col("n") / F.size("units")).cast("long").alias("copies"), "units")


def cut(text: str | None, starts: np.ndarray, ends: np.ndarray) -> tuple[str | None, np.ndarray, np.ndarray]:
    """The text without the spans, which are in order of their starts, and these, joined where they touch or overlap."""
    if not len(starts):
        return text, starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.r_[True, starts[1:] > reach[:-1]]
    starts, ends = starts[new], reach[np.r_[new[1:], True]]
    return None if text is None else "".join([text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)])]), starts, ends


def _with_cut(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds the column `name`: struct of text and removed, from the text and the column UNITS."""

    @F.pandas_udf("text string, starts array<int>, ends array<int>")
    def run(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(t, s, e) for t, s, e in zip(text, starts, ends)], columns=["text", "starts", "ends"], index=text.index)

    side = lambda k: F.coalesce(F.transform(UNITS, lambda u: u[k]), F.array().cast("array<int>"))
    out = df.withColumn(CUT_TEXT, run(F.col(f"`{text_col}`").cast("string"), side("start"), side("end")))
    spans = F.arrays_zip(F.col(f"{CUT_TEXT}.starts").alias("start"), F.col(f"{CUT_TEXT}.ends").alias("end")).cast("array<struct<start: int, end: int>>")
    return out.withColumn(name, F.struct(F.col(f"{CUT_TEXT}.text").alias("text"), spans.alias("removed"))).drop(CUT_TEXT, UNITS)


def _keyed(df: DataFrame, id_col: str, key: Column, name: str) -> DataFrame:
    """Adds one column, never null, that documents share if they agree in doc_id and text."""
    ident = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null"))
    return df.withColumn(name, F.concat_ws("|", ident, key))


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, least_line: int | None = None) -> DataFrame:
    """A row for each row of docs that loses text: doc_id, text (what is left), n_chars (before), removed, units."""
    found = common.stage(removals(repeated_units(docs, id_col, text_col, least, least_line)), "removals")
    found = _keyed(found, "doc_id", F.col("text_key"), "key").select("key", "copies", "units", F.col("units").alias(UNITS))
    own = _keyed(docs.select(id_col, text_col), id_col, _key(text_col), "key").select("key", F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    many = max(2, int(found.agg(F.sum("copies")).first()[0] or 0) // 1000)
    if found.filter(F.col("copies") >= many).isEmpty():
        both = own.join(found, "key")
    else:  # rows that repeat in full so often are at most a thousand, and joined by broadcast
        hot = F.broadcast(found.filter(F.col("copies") >= many))
        both = own.join(hot, "key").unionByName(own.join(F.broadcast(hot.select("key")), "key", "left_anti").join(found.filter(F.col("copies") < many), "key"))
    return _with_cut(both, "text", "left").select("doc_id", "left.text", F.length("text").alias("n_chars"), "left.removed", "units")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, least_line: int | None = None) -> DataFrame:
    """docs with all their columns; repeats are cut from the text, and removed (array of start, end) has their spans in the original.

    If docs has a column `removed`, the new one is `removed_`.
    """
    key, name = common.unused(docs, "_key"), common.unused(docs, "removed")
    spans = removals(repeated_units(docs, id_col, text_col, least, least_line))
    spans = _keyed(spans, "doc_id", F.col("text_key"), key).select(key, F.col("units").alias(UNITS))
    left = common.unused(docs, "_left")
    both = _with_cut(_keyed(docs, id_col, _key(text_col), key).join(spans, key, "left"), text_col, left)
    return both.select(*[F.col(f"{left}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.col(f"{left}.removed").alias(name))
