"""Exact dedup against a persistent digest index.

The index is a Parquet table, bucketed and sorted by the SHA-256 of the text, with the doc_id that
stands for each digest. A batch is reduced to one row a digest, deduplicated against the index by a
sort-merge anti-join that shuffles only the batch, and what is new is appended. Where a bucket has
more than MERGE files, all are merged into a new version of the table, one sorted file a bucket; a
version counts once it is whole, so a run that is lost midway leaves the last one. A table of
documents may go through the index in several batches, largest doc_ids first, so that each batch
meets the digests of those before.

Documents are joined back by digest; digests with many copies are joined by broadcast, as there are
few of them. Rows that repeat in full a thousandth of all rows' times or more are reduced to one
where they lie, so their texts don't meet in one task.

Defined results: a null text counts as empty, empty texts equal each other; of equal texts in one
call the largest doc_id stays, and null doc_ids rank below all others; of rows that repeat a
doc_id and its text, one stays; a digest that the index already held keeps its old keep_id, so
all its new copies go. No rows give no rows and leave the index as it is.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


MERGE = 16  # files of a bucket, on average, before they are merged


class DigestIndex:
    """The bucketed table under `path`; `buckets` has to stay the same over its life."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets
        self._open(max(self._versions(), default=0))

    @classmethod
    def sized(cls, spark: SparkSession, path: str, rows: int, rows_per_bucket: int = 4_000_000) -> DigestIndex:
        """A new index for a number of documents: a power of two of buckets, 32 at least, that sort in a task's memory."""
        return cls(spark, path, max(32, 1 << (max(1, rows // rows_per_bucket) - 1).bit_length()))

    def _versions(self) -> list[int]:
        """The versions that were written to their end."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath() for x in fs.listStatus(root)] if fs.exists(root) else []
        return [int(x.getName()[1:]) for x in found if x.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]

    def _open(self, version: int) -> None:
        self.version = version
        self.name = f"digest_index_{hashlib.md5(f'{self.path}|{self.buckets}|{version}'.encode()).hexdigest()}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING PARQUET "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/v{version:06}'"
        )
        self.spark.catalog.refreshTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The rows of groups whose digest the index lacks: only groups is shuffled, to the index's buckets."""
        return groups.repartition(self.buckets, "digest").join(self.table().hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Adds digests that the index lacks, one sorted file a bucket; merges the files where there are many."""
        self.fresh(groups).select("digest", "keep_id").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        if len(self.table().inputFiles()) > MERGE * self.buckets:
            self.merge()

    def merge(self) -> None:
        """One file a bucket again, as a new version of the table."""
        whole = self.spark.read.parquet(f"{self.path}/v{self.version:06}").repartition(self.buckets, "digest")  # by its path: a scan of buckets needs no shuffle, and would be read in many parts then
        self._open(self.version + 1)
        whole.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, copies) with repeated rows folded into a count."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("digest"))
    return rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256; the index has all digests afterwards."""
    rows = common.stage(digests(docs, id_col, text_col), "digests")
    borders = sorted(set(rows.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    groups = common.stage(rows.groupBy("digest").agg(F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("ids")), "groups")
    news = []
    for low, high in zip([None, *borders][::-1], [*borders, None][::-1]):  # largest doc_ids first, null ones last
        part = rows if high is None else rows.filter(F.col("doc_id").isNull() | (F.col("doc_id") < int(high))) if low is None else rows.filter(F.col("doc_id") < int(high))
        part = part if low is None else part.filter(F.col("doc_id") >= int(low))
        news.append(common.stage(index.fresh(part.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))), "fresh"))
        index.append(news[-1])
    fresh = reduce(DataFrame.unionByName, news)
    known = groups.repartition(index.buckets, "digest").join(index.table().hint("merge").withColumnRenamed("keep_id", "stays"), "digest")
    known = known.join(fresh.select("digest", F.lit(True).alias("new")).repartition(index.buckets, "digest").hint("merge"), "digest", "left")
    keep = known.select("digest", F.col("stays").alias("keep_id"), "group_size", "ids", F.coalesce("new", F.lit(False)).alias("new"))
    out = common.join_hot(rows, keep, "digest", "ids", rows.count())
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "keep_id", "group_size", (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_documents(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that agree in doc_id and text, any one."""

    # One key that is never null: the join deals rows by it, and the window that follows needs no other shuffle of the texts.
    def key(digest: Column, ident: Column) -> Column:
        return F.concat(digest, F.coalesce(ident.cast("long").cast("string"), F.lit("null")).cast("binary"))

    name, copy = common.unused(docs, "_key"), common.unused(docs, "_copy")
    decided = common.stage(dedup(docs, index, id_col, text_col).select(key(F.unhex("text_sha256"), F.col("doc_id")).alias(name), "kept"), "decided")
    stays = decided.filter("kept").select(name)
    often = decided.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(1000, int(decided.count() * common.HOT_SHARE))).select(name)
    often = F.broadcast(common.stage(often, "often"))  # 1 / HOT_SHARE rows at most
    tagged = docs.withColumn(name, key(F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)), F.col(id_col)))
    first = Window.partitionBy(name).orderBy(name)
    one = lambda df: df.join(stays, name, "left_semi").withColumn(copy, F.row_number().over(first)).filter(F.col(copy) == 1).select(*common.columns(docs))
    if often.isEmpty():
        return one(tagged)
    same = tagged.join(often.join(stays, name, "left_semi"), name, "left_semi").groupBy(name).agg(F.first(F.struct(*common.columns(docs))).alias("row"))
    return one(tagged.join(often, name, "left_anti")).unionByName(same.select("row.*"))
