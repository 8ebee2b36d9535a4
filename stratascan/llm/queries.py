"""The registered queries of this subpackage: production parameters, whole tables; and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scan
from . import bpe, common, exact_dedup, host_rules, html_text, language_id, line_dedup, mixing, sharding, simhash, toxicity
from .vocabularies import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan.open_table(spark, f"{sf_dir}/{name}.parquet")


def op1_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), shards=8)


def op2_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.cut_documents(_table(spark, sf_dir, "documents"), least_line=0)
    return out.select("doc_id", "n_chars", F.length("text").alias("n_left"), F.lower(F.sha2("text", 256)).alias("left_sha256"), "removed", "units")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Native: no Python looks at footers, so Spark's row reader, which reads any encoding right, is taken. Texts are read within judge().
    with scan.row_reader(spark):
        out = host_rules.judge(scan.open_table(spark, f"{sf_dir}/documents.parquet", engine="spark"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), tokenizer_path)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_documents(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex.sized(spark, common.scratch_path(spark, "digest_index"), docs.count())  # from footers
    return exact_dedup.dedup(docs, index, batches=2)  # so that the second meets the digests of the first


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), most=3.0, shards=8)
    return out.select("doc_id", "size", "source_size", "target", "taken", F.transform("copies", lambda c: c["shard"]).alias("shards"), F.transform("copies", lambda c: c["words"]).alias("words"))


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language_id.train(language_id.training_sample(docs, "doc_id", "text", "lang", fold("doc_id", 4) != 2))
    out = language_id.identify(docs.select("doc_id", "text"), net)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_label_propagation, op2_tag_path_text, op3_line_dedup, op4_host_rules, op5_bpe_tree, op6_simhash, op7_exact_dedup, op8_source_mix, op9_toxicity, op10_language_id)}


OP4_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
     w AS MATERIALIZED (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
     g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
     h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS k FROM g),
     p AS (SELECT r, count(DISTINCT i + o) AS n FROM h, (VALUES (0), (1), (2)) AS x(o) WHERE k > 1 GROUP BY r),
     l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM
             (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
     c AS (SELECT w.r, doc_id, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
             coalesce(p.n, 0) AS n_repeat_words FROM w LEFT JOIN p ON p.r = w.r LEFT JOIN l ON l.r = w.r),
     f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words AS symbols_failed,
             10 * n_dup_lines > 3 * n_lines AS lines_failed FROM c),
     o AS (SELECT source, count(*) AS n, unnest([count(*) FILTER (base_failed), count(*) FILTER (symbols_failed), count(*) FILTER (lines_failed)]) AS bad,
             unnest([1, 2, 3]) AS rule FROM f WHERE source IS NOT NULL GROUP BY source),
     m AS (SELECT rule, avg(bad / n) AS mean, coalesce(var_samp(bad / n), 0) AS v FROM o GROUP BY rule),
     s AS (SELECT rule, mean, least(1e6, greatest(2.0, CASE WHEN v > 0 THEN mean * (1 - mean) / v - 1 ELSE 1e6 END)) AS strength FROM m),
     v AS (SELECT source, bool_or((bad + mean * strength) / (n + strength) > 0.5) AS host_failed FROM o JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_failed, false) AS kept, coalesce(host_failed, false) AS host_failed
FROM f LEFT JOIN v ON v.source = f.source
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
     r AS (SELECT *, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
                  row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) AS k FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, h AS text_sha256 FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_host_rules": OP4_SQL, "op7_exact_dedup": OP7_SQL}
