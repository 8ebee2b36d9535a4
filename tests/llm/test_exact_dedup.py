import hashlib
from collections import Counter

from stratascan.llm import common, exact_dedup


def brute(rows):
    group = Counter(t or "" for _, t in rows)
    keep = {}
    for i, t in rows:
        if i is not None:
            keep[t or ""] = max(keep.get(t or "", i), i)
    return group, keep


def test_batches_against_brute_force(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (6, "long " * 9000), (7, "A")] + [(100 + k, "hot") for k in range(900)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, digest string, kept string")
    index = exact_dedup.DigestIndex(spark, common.scratch_path(spark, "index"), buckets=4)
    got = exact_dedup.dedup(docs, index).collect()
    group, keep = brute(rows)
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        t = text[r.doc_id] or ""
        assert (r.keep_id, r.group_size) == (keep[t], group[t])
    kept = [r.doc_id for r in got if r.kept]
    assert sorted(kept) == sorted(keep.values())
    # a second batch: old texts go, new ones are appended
    more = spark.createDataFrame([(2000, "hot"), (2001, "new"), (2002, "new")], "doc_id long, text string")
    second = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(more, index).collect()}
    assert second == {2000: (999, False), 2001: (2002, False), 2002: (2002, True)}
    assert index.table().count() == len(group) + 1


def test_kept_documents_have_their_columns(spark):
    rows = [(1, "a", "p"), (2, "a", "q"), (5, "b", "r"), (5, "b", "r"), (None, "c", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    index = exact_dedup.DigestIndex(spark, common.scratch_path(spark, "index"), buckets=2)
    out = exact_dedup.keep_documents(docs, index)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, [r for r in docs.collect() if (r.doc_id, r.text) != (1, "a")][:2] + docs.filter("doc_id is null").collect()))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, common.scratch_path(spark, "index"), buckets=2)
    assert exact_dedup.dedup(docs, index).count() == 0 == exact_dedup.dedup(docs, index, batches=2).count()
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (None, "a")], "doc_id long, text string")
    other = exact_dedup.DigestIndex(spark, common.scratch_path(spark, "index"), buckets=2)
    assert sorted((r.group_size, r.kept) for r in exact_dedup.dedup(nulls, other, batches=2).collect()) == [(1, True), (2, False), (2, True)]
    assert index.table().count() == 0


def test_sized_index(spark):
    sizes = [exact_dedup.DigestIndex.sized(spark, common.scratch_path(spark, f"index{n}"), n).buckets for n in (0, 10**6, 128_000_000, 129_000_000, 10**9)]
    assert sizes == [32, 32, 32, 32, 256]
    assert exact_dedup.DigestIndex.sized(spark, common.scratch_path(spark, "index"), 40, rows_per_bucket=1).buckets == 64


def test_batches_of_one_table(spark):
    """However many batches, results are those of one; later batches meet old digests, and add none of them."""
    rows = [(k, f"text {k % 40}") for k in range(200)] + [(None, "text 3"), (None, "only null"), (None, None), (7, "text 7"), (500, "text 500")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    group, keep = brute(rows)
    want = sorted((str(i), str(keep.get(t or "")), group[t or ""]) for i, t in rows)
    for batches in (1, 2, 5):
        index = exact_dedup.DigestIndex(spark, common.scratch_path(spark, "index"), buckets=2)
        got = exact_dedup.dedup(docs, index, batches=batches).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
        assert sum(r.kept for r in got) == len(group) == index.table().count() == index.table().select("digest").distinct().count()
        assert {r.text_sha256: r.doc_id for r in got if r.kept} == {hashlib.sha256(t.encode()).hexdigest(): keep.get(t) for t in group}


def test_many_files_are_merged(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MERGE", 2)
    path = common.scratch_path(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, buckets=2)
    for k in range(7):
        exact_dedup.dedup(spark.createDataFrame([(100 * k + j, f"text {j if j < 3 else 100 * k + j}") for j in range(30)], "doc_id long, text string"), index)
        assert len(index.table().inputFiles()) <= 2 * 2
    assert index.version > 0 and index.table().count() == 30 + 6 * 27 == index.table().select("digest").distinct().count()
    again = exact_dedup.DigestIndex(spark, path, buckets=2)  # as another run finds it
    assert again.version == index.version and again.table().count() == index.table().count()


def test_a_row_that_repeats_in_full(spark):
    rows = [(1, "the same text in all rows", "x")] * 5000 + [(2, "the same text in all rows", "y")] * 3000 + [(k, f"own {k}", "z") for k in range(10, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    index = exact_dedup.DigestIndex(spark, common.scratch_path(spark, "index"), buckets=2)
    out = exact_dedup.keep_documents(docs, index)
    assert sorted(map(tuple, out.collect())) == sorted({(2, "the same text in all rows", "y")} | {r for r in rows if r[0] >= 10})
