"""The corpus pipeline: documents in, a deduplicated, mixed and encoded training corpus out.

Each stage takes (spark, docs, sf_dir) and returns a frame; it works on all that its predecessor
kept, with the same operators and parameters as the single queries. All but the last return the
columns of documents. The driver writes a stage's rows as Parquet and rereads them for the next;
run() does the same in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratascan.llm import bpe, common, exact_dedup, language_id, mixing, simhash
from stratascan.llm.queries import fold
from stratascan.llm.vocabularies import tokenizer_path
from stratascan.sources import scan


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without letters, or that resemble no language that was learned, go."""
    net = language_id.train(language_id.training_sample(docs, "doc_id", "text", "lang", fold("doc_id", 4) != 2))
    return language_id.keep_identified(docs, net)


def exact_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    index = exact_dedup.DigestIndex.sized(spark, common.scratch_path(spark, "digest_index"), docs.count())
    return exact_dedup.keep_documents(docs, index)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose wide fingerprints of five-word shingles link at a similarity of 0.8, the row with the smallest doc_id."""
    return simhash.keep_dissimilar(docs, shingle=5, similar=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, none to three times, so that each source comes near its target."""
    return mixing.mixed_documents(docs, weights=(5.0, 2.0, 1.0), most=3.0, shards=8)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids, for each row of the mix."""
    return bpe.encode_digests(docs, tokenizer_path, with_ids=True, remembered=100_000)  # beside what earlier stages hold


STAGES = [
    ("language_id", identified),
    ("exact_dedup", exact_deduplicated),
    ("simhash_near_dedup", near_deduplicated),
    ("source_mix", mixed),
    ("bpe_encode", encoded),
]

#: Fingerprints, networks and byte-pair ranks have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = scan.open_table(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
