"""The registered queries over whole small tables, against SQL or brute force."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from stratascan.llm import queries
from stratascan.sources import sink
from tests.llm.test_line_dedup import brute as brute_repeats
from tests.llm.test_line_dedup import flat
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import brute_components, brute_fingerprint

SMALL, LARGER = Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(SMALL / "documents.parquet").to_pylist()


def run(spark, name, at=SMALL):
    return queries.queries()[name](spark, str(at))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    df, rel = run(spark, name), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in rel.fetchall())


def test_op1(spark, docs):
    rows = run(spark, "op1_label_propagation").collect()
    text = {d["doc_id"]: d["text"] for d in docs}
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(docs) and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    spread = defaultdict(set)
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        spread[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in spread.values())  # no group here is larger than a shard
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s])) for s in range(8))


def test_op2(spark):
    pages = {p["page_id"]: p for p in pq.read_table(SMALL / "pages.parquet").to_pylist()}
    rows = run(spark, "op2_tag_path_text").collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id]["html"], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", article))]
        assert (r.text, r.n_chars, r.url) == ("\n\n".join(filter(None, blocks)), len(r.text), pages[r.page_id]["url"])


def test_op3(spark, docs):
    rows = run(spark, "op3_line_dedup").collect()
    want = brute_repeats([(d["doc_id"], d["text"]) for d in docs], least_line=0)
    assert flat(rows) == want
    text, cut = {d["doc_id"]: d["text"] for d in docs}, defaultdict(set)
    for i, s, e, *_ in want:
        cut[i] |= set(range(s, e))
    assert {r.doc_id for r in rows} == set(cut) and len(rows) == len(cut)
    for r in rows:
        left = "".join(c for k, c in enumerate(text[r.doc_id]) if k not in cut[r.doc_id])
        assert (r.n_chars, r.n_left, r.left_sha256) == (len(text[r.doc_id]), len(left), hashlib.sha256(left.encode()).hexdigest())
        assert {k for s in r.removed for k in range(s.start, s.end)} == cut[r.doc_id]


def test_op5(spark, docs):
    whole = Tokenizer.from_file(queries.tokenizer_path())
    whole.no_truncation(), whole.no_padding()
    got = {r.doc_id: r for r in run(spark, "op5_bpe_tree").collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = whole.encode(d["text"], add_special_tokens=False).ids
        decoded = whole.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert tuple(got[d["doc_id"]])[1:] == want


def test_op6(spark, docs):
    fps = [(d["doc_id"], brute_fingerprint(d["text"])) for d in docs]
    want = sorted((i, f"{fp:016x}", c) for (i, fp), c in zip(fps, brute_components(fps)))
    assert sorted(map(tuple, run(spark, "op6_simhash").collect())) == want


def test_op8(spark, docs):
    size, taken = Counter(), Counter()
    source = {d["doc_id"]: d["source"] for d in docs}
    for d in docs:
        size[d["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"]))
    order = sorted(size)
    want = dict(zip(order, brute_targets([size[s] for s in order], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(order))])))
    rows = run(spark, "op8_source_mix").collect()
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)


def test_op9(spark):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(LARGER / "labels.parquet").to_pylist()}
    rows = run(spark, "op9_toxicity", LARGER).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 0], [s for s, y in held if y == 1]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))
    assert auc > 0.75  # six toxic documents are held out here


def test_op10(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(LARGER / "documents.parquet").to_pylist()}
    rows = run(spark, "op10_language_id", LARGER).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [lang[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_tables_are_read_right_in_every_encoding(spark, tmp_path):
    """Texts in an encoding that Spark's vectorized reader gets wrong come right to the queries, to the one without Python too."""
    texts = [(k, f"a line of its own, number {k:05}", "s") for k in range(2000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, source string").coalesce(1)
    sink.write(rows, f"{tmp_path}/documents.parquet", sink.WriterOptions(version_2=True, dictionary=False))
    want = {k: hashlib.sha256(t.encode()).hexdigest() for k, t, _ in texts}
    assert {r.doc_id: r.text_sha256 for r in run(spark, "op7_exact_dedup", tmp_path).collect()} == want
    assert {r.word_chars for r in run(spark, "op4_host_rules", tmp_path).collect()} == {len(texts[0][1].replace(" ", ""))}
