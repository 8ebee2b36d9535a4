"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document gets its counts and rule failures from one projection of its text. Failures are
summed by host; the hosts' failure rates give an empirical beta prior by the method of moments,
towards which each host's own rate is shrunk. A host whose shrunk rate for any rule is over the
limit fails, and with it all its documents. Verdicts join back by host: hosts with a thousandth of
the rows or more (so a thousand at most) by broadcast, all others by shuffle.

Rules: `base` (fewer than 50 words, or more than half of the words in repeated 3-word windows),
`symbols` (more than one symbol in ten words), `lines` (more than 30 % of the lines that have words
repeat an earlier line).

Defined results: a null text has no words; a null host is no host, so such documents have their
own verdict only; rows that repeat count each; with one host, or hosts that all have one rate, the
prior is as strong as it may get (PRIOR_MOST), and with rates as far apart as they can be, as weak
(PRIOR_LEAST); an empty table gives no rows. 3-word windows are equal if 64-bit hashes of their
words are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RULES = ("base", "symbols", "lines")
PRIOR_LEAST, PRIOR_MOST = 2.0, 1e6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        repeated = let(placed, lambda s: F.transform(F.filter(s, lambda y, k: (F.get(s, k - 1)["x"] == y["x"]) | (F.get(s, k + 1)["x"] == y["x"])), lambda y: y["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        grow = lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"))
        return F.aggregate(F.sort_array(repeated), start, grow, lambda acc: acc["n"])

    n = F.size(words)
    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))
    return F.when(n < 3, F.lit(0)).otherwise(let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == n - 2, F.lit(0)).otherwise(covered(h))))


def counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, all long."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(common.SPACES))) > 0)

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    return let(common.words(text), lambda w: let(lines, lambda x: of(w, x)))


def prior(mean: float, variance: float) -> tuple[float, float]:
    """Beta parameters by the method of moments, with strength kept in [PRIOR_LEAST, PRIOR_MOST]."""
    strength = mean * (1 - mean) / variance - 1 if variance > 0 else PRIOR_MOST
    strength = min(PRIOR_MOST, max(PRIOR_LEAST, strength))
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = 0.5) -> DataFrame:
    """One row for each row of docs: doc_id, host, the counts, base_failed, host_failed, kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), counts(F.col(text_col)).alias("c")).select("doc_id", "host", "c.*")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = rows.withColumn("symbols_failed", 10 * F.col("n_symbols") > F.col("n_words")).withColumn("lines_failed", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
    rows = common.stage(rows, "rows")

    hosts = rows.filter("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"{r}_failed")).alias(r) for r in RULES])
    hosts = common.stage(hosts, "hosts")
    rates = [f(F.col(r) / F.col("n")).alias(f"{r}_{f.__name__}") for r in RULES for f in (F.avg, F.var_samp)]
    moments = hosts.agg(F.sum("n").alias("rows"), *rates).first().asDict()  # one row
    failed = F.lit(False)
    for r in RULES:
        a, b = prior(moments[f"{r}_avg"] or 0.0, moments[f"{r}_var_samp"] or 0.0)
        failed = failed | ((F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b)) > F.lit(limit))
    verdicts = hosts.select("host", "n", failed.alias("host_failed"))
    out = common.join_hot(rows.filter("host is not null"), verdicts, "host", "n", moments["rows"] or 0)
    out = out.drop("n").unionByName(rows.filter("host is null").withColumn("host_failed", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
