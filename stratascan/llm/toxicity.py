"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text, the beginnings of longer ones, and pairs of words of which
one names a group of people. In labelled sentences each identity term is swapped for others of its
set, and the squared change of the score is penalised, so that a mention doesn't raise it by itself.

Swap sets are of two kinds. Those of GROUPS are a seed: names of groups of people. All others are
learned from the labelled sample: a word that goes with the toxic label (it is a feature) but that
clean texts have too is a term; its set are the words that don't, and are of most like distribution, by the cosine of
the counts of frequent words on its left and right (NEIGHBOURS most frequent neutral words, CONTEXTS
frequent words).

Training takes about SAMPLE labelled documents, those whose ids hash lowest, evenly from both labels;
the features are what at least LEAST_DOCS of them have and what goes with the label (chi-square of
LEAST_CHI or more), and the names of groups. All sentences of these documents give pairs; pairs that
change the features alike are one, with their number. Only the features of that sample, these changes
and counts by word are on the driver. Scoring reads every whole text in one pass.

Defined results: a null text is scored as the empty one, which gets the score of the bias alone;
without labels of both kinds all scores are 0; documents with null or several labels teach the
larger one, equal texts teach once; rows that repeat get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

STEM = 6  # characters of a longer word's beginning
SAMPLE, LEAST_DOCS, LEAST_CHI = 10_000, 4, 15.0
LEAST_CLEAN, NEIGHBOURS, CONTEXTS, LIKE, ALTERNATIVES = 5, 2000, 64, 0.6, 3  # of swap sets: clean documents that have a term, ..., least cosine, words in a set

# Names of groups of people by kind; within a kind they swap.
GROUPS = (
    ("women", "men", "girls", "boys", "ladies", "gentlemen"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "heterosexual", "homosexual", "queer"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european"),
    ("americans", "mexicans", "chinese", "germans", "russians", "indians", "turks", "poles"),
    ("immigrants", "refugees", "foreigners", "locals", "natives", "citizens"),
    ("elderly", "young", "old", "teenage"),
    ("disabled", "deaf", "blind", "autistic", "paralyzed"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "musulmanes", "judíos", "hindúes"),
)
KIND = {name: k for k, names in enumerate(GROUPS) for name in names}

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?\n]+")


def features(words: list[str]) -> set[str]:
    out = set(words)
    out |= {w[:STEM] + "~" for w in out if len(w) > STEM}
    if not out.isdisjoint(KIND):
        out |= {f"{a} {b}" for a, b in zip(words, words[1:]) if a in KIND or b in KIND}
    return out


def counterfactuals(text: str, swaps: dict[str, list[str]]) -> list[tuple[set[str], set[str]]]:
    """For each term in each sentence, and each word of its set: the features that the sentence loses and gains by the swap."""
    out = []
    for sentence in SENTENCE_END.split(text.lower()):
        words = WORD.findall(sentence)
        terms = [w for w in dict.fromkeys(words) if w in swaps]
        if not terms:
            continue
        own = features(words)
        for term in terms:
            for other in swaps[term]:
                changed = features([other if w == term else w for w in words])
                out.append((own - changed, changed - own))
    return out


#: The seed sets as swaps.
SEED_SWAPS = {name: [x for x in names if x != name] for names in GROUPS for name in names}


def learned_swaps(terms: list[str], neutral: list[str], contexts: dict[tuple[str, int], int], width: int) -> dict[str, list[str]]:
    """For each term the neutral words of most like distribution; contexts: (word, context) and how often."""
    words = [*terms, *neutral]
    place = {w: k for k, w in enumerate(words)}
    table = np.zeros((len(words), width))
    for (w, c), n in contexts.items():
        table[place[w], c] = n
    table = np.sqrt(table)
    table /= np.maximum(1e-12, np.linalg.norm(table, axis=1, keepdims=True))
    out = {}
    for k, term in enumerate(terms):
        like = table[len(terms) :] @ table[k]
        best = [j for j in np.argsort(-like, kind="stable")[:ALTERNATIVES] if like[j] >= LIKE]
        if best:
            out[term] = [neutral[j] for j in best]
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    swaps: dict[str, list[str]] = field(default_factory=dict)  # learned and seed sets
    pairs: int = 0  # counterfactual pairs that were penalised

    def logit(self, text: str | None) -> float:
        words = WORD.findall((text or "").lower())
        return self.bias + sum(map(self.weights.__getitem__, features(words) & self.weights.keys()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -40, 40))))


def fit(rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], size: int, ridge: float = 2e-4, fairness: float = 1.0, steps: int = 500, rate: float = 0.1, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise balanced log loss + ridge * |w|^2 + fairness * mean squared change over pairs (pair k counts times[k] times), by Adam."""
    flat = lambda lists: (np.concatenate([np.array(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64), np.array(list(map(len, lists)), np.int64))
    at, lengths = flat(rows)
    row = np.repeat(np.arange(len(rows)), lengths)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    pair_at, pair_lengths = flat([[*a, *b] for a, b in pairs])
    pair_row = np.repeat(np.arange(len(pairs)), pair_lengths)
    sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in pairs]) if pairs else np.zeros(0)
    often = np.ones(len(pairs)) if times is None else np.asarray(times, float)
    w, bias = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        logit = np.bincount(row, w[at], len(rows)) + bias
        off = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels) * weight
        g = np.bincount(at, off[row], size) + 2 * ridge * w
        if pairs:
            change = np.bincount(pair_row, w[pair_at] * sign, len(pairs)) * often
            g += 2 * fairness / often.sum() * np.bincount(pair_at, change[pair_row] * sign, size)
        gb = off.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        now = rate * (1 - step / (steps + 1))
        w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= now * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, fairness: float = 1.0) -> Model | None:
    """Learns from labels(id, label 0/1) where may_learn (over the id column) holds; None without both labels."""
    known = labels.filter(may_learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    share = {y: int(1_000_000 * min(1.0, sample / 2 / n)) for y, n in counts.items()}
    picked = known.filter(F.when(F.col("y") == 1, F.col("h") < share[1]).otherwise(F.col("h") < share[0])).select("doc_id", "y")  # sample rows, or a few hundred more or less
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Of equal texts one is enough: copies would make any rare word of a toxic text look toxic.
    texts = common.stage(texts.join(F.broadcast(picked), "doc_id").select("y", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["text", "y"]), "labelled")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sorted(features(WORD.findall(t.lower()))) for t in part.column(1).to_pylist()], pa.list_(pa.string()))], ["y", "words"])

    found = common.stage(texts.mapInArrow(extract, "y int, words array<string>"), "features")
    total, toxic = found.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not toxic or toxic == total:
        return None
    counted = found.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").cast("double").alias("k"))
    # Chi-square of word and label, one degree of freedom: total * (k * total - n * toxic)^2 / (n * (total - n) * toxic * (total - toxic)).
    off = F.col("k") * total - F.col("n") * toxic
    counted = common.stage(counted.filter(F.col("n") >= LEAST_DOCS).withColumn("chi", total * off * off / (F.col("n") * (total - F.col("n") + 0.5) * toxic * (total - toxic))), "counted")
    words = sorted({*(r.word for r in counted.filter(F.col("chi") >= LEAST_CHI).select("word").collect()), *KIND})
    place = {w: k for k, w in enumerate(words)}

    swaps = SEED_SWAPS | _learn_swaps(texts, counted, toxic / total) if fairness else SEED_SWAPS

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[place[x] for x in xs if x in place] for xs in part.column(1).to_pylist()], pa.list_(pa.int32()))], ["y", "at"])

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = lambda xs: tuple(sorted(place[x] for x in xs if x in place))
        for batch in batches:
            seen: Counter = Counter((only(a), only(b)) for t in batch.column(1).to_pylist() for a, b in counterfactuals(t, swaps))
            keys = [x for x in seen if x[0] or x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([list(a) for a, _ in keys], ints), pa.array([list(b) for _, b in keys], ints), pa.array([seen[x] for x in keys], pa.int64())], ["a", "b", "n"])

    ints = pa.list_(pa.int32())
    rows = found.mapInArrow(index, "y int, at array<int>").toArrow().to_pydict()
    order = sorted(range(len(rows["y"])), key=lambda k: (rows["y"][k], rows["at"][k]))
    y = np.array([rows["y"][k] for k in order])
    pairs = texts.mapInArrow(changes, "a array<int>, b array<int>, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow().to_pydict() if fairness else {"a": [], "b": [], "n": []}
    by = sorted(range(len(pairs["n"])), key=lambda k: (pairs["a"][k], pairs["b"][k]))
    w, bias = fit([rows["at"][k] for k in order], y, [(pairs["a"][k], pairs["b"][k]) for k in by], len(words), fairness=fairness, times=np.array([pairs["n"][k] for k in by], float))
    return Model({x: float(w[k]) for x, k in place.items() if abs(w[k]) > 1e-3}, bias, swaps, int(sum(pairs["n"])))


def _learn_swaps(texts: DataFrame, counted: DataFrame, base: float) -> dict[str, list[str]]:
    """Swap sets of the words that go with the label and that clean texts have too; base: the share of toxic texts."""
    whole = counted.filter(~F.col("word").contains("~") & ~F.col("word").contains(" "))
    clean = F.col("n") - F.col("k")
    terms = sorted(r.word for r in whole.filter((F.col("chi") >= LEAST_CHI) & (clean >= LEAST_CLEAN) & (F.col("k") > base * F.col("n"))).select("word").collect())
    terms = [w for w in terms if w not in KIND]
    calm = whole.filter(((F.col("chi") < LEAST_CHI) | (F.col("k") <= base * F.col("n"))) & (clean >= LEAST_CLEAN)).orderBy(F.desc("n"), "word")
    neutral = [r.word for r in calm.select("word").limit(NEIGHBOURS).collect() if r.word not in KIND]
    common_words = {r.word: k for k, r in enumerate(whole.orderBy(F.desc("n"), "word").select("word").limit(CONTEXTS).collect())}
    if not terms or not neutral:
        return {}
    wanted = {*terms, *neutral}

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column(1).to_pylist():
                words = WORD.findall(t.lower())
                seen.update((w, common_words[x]) for x, w in zip(words, words[1:]) if w in wanted and x in common_words)
                seen.update((w, CONTEXTS + common_words[x]) for w, x in zip(words, words[1:]) if w in wanted and x in common_words)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in keys], pa.string()), pa.array([c for _, c in keys], pa.int32()), pa.array([seen[x] for x in keys], pa.int64())], ["w", "c", "n"])

    got = texts.mapInArrow(around, "w string, c int, n long").groupBy("w", "c").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    return learned_swaps(terms, neutral, dict(zip(zip(got["w"], got["c"]), got["n"])), 2 * CONTEXTS)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (as it is), score, predicted for each row of docs."""
    kind = docs.select(F.col(id_col).alias("doc_id")).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                s = [model.score(t) if model else 0.0 for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, score double, predicted int")
