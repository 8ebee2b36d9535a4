import hashlib
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from stratascan.llm import mixing
from tests.llm.test_simhash import brute_similar

RNG = random.Random(11)
PARTS = {"xx": ["tion", "the", "ing", "ough", "sh", "ea", "wr"], "yy": ["ción", "ñe", "que", "lla", "os", "ir", "zu"]}


def text(lang, n):
    return " ".join("".join(RNG.choice(PARTS[lang]) for _ in range(RNG.randint(1, 4))) for _ in range(n))


def make():
    rows = [[k, text(lang, RNG.randint(5, 150)), lang, f"src{k % 3}"] for k, lang in enumerate(["xx", "yy"] * 60)]
    rows += [[200 + k, rows[k][1], "xx", "src1"] for k in range(8)]  # exact copies
    rows += [[300 + k, rows[100 + k][1] + " ing" * (k % 3), None, None] for k in range(12)]  # near copies
    rows += [[400, None, "xx", "src0"], [401, "", "yy", "src0"], [402, "12 34 !!", "xx", "src1"]]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages_against_brute_force(spark, tmp_path):
    rows = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
    assert sorted(r.doc_id for r in kept[0]) == sorted(i for i, *_ in rows if i < 400)
    last = {}
    for i, t, *_ in rows:
        if i < 400:
            last[t] = max(i, last.get(t, i))
    assert sorted(r.doc_id for r in kept[1]) == sorted(last.values())
    left = sorted((i, t) for t, i in last.items())
    groups = brute_similar(left)  # five-word shingles, similarity 0.8
    alone = [i for (i, _), c in zip(left, groups) if i == c]
    assert sorted(r.doc_id for r in kept[2]) == alone and len(alone) < len(left)
    by = {i: (t, s) for i, t, _, s, _ in rows}
    took, size = Counter(), Counter()
    for r in kept[3]:
        assert (r.text, r.source, r.n_chars) == (by[r.doc_id][0], by[r.doc_id][1], len(r.text))
        took[r.source] += len(r.text.split())
    for i in alone:
        size[by[i][1]] += len(by[i][0].split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in order], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(order))])
    assert all(abs(took[s] - w) <= 80 for s, w in zip(order, want))  # half of the longest document
    assert max(Counter(r.doc_id for r in kept[3]).values()) <= 3
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in kept[4]:
        ids = whole.encode(by[r.doc_id][0], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.ids_sha256) == (ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(map(str, again)) == Counter(map(str, kept[4]))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    """Columns with the names that stages use, null ids, a very long text, rows that repeat: every stage's columns and rows stay whole."""
    rows = [(*r, 1.5, "k", 7, None) for r in make()[:80]]
    long = text("xx", 60_000)
    rows += [(900, long, "xx", "src0", len(long), 0.0, "k", 7, "x")] * 2 + [(None, text("yy", 80), "yy", "src1", 9, 0.0, None, 7, "x"), (None, text("yy", 90), "yy", None, 9, 0.0, None, 7, "x")]
    names = "doc_id long, text string, lang string, source string, n_chars long, fp double, `key` string, size int, `row.key` string"
    docs = spark.createDataFrame(rows, names)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        kept.append(Counter(r.doc_id for r in docs.collect()))
    assert kept[0][900] == 2 and kept[1][900] == kept[2][900] == 1 and all(k[None] == 2 for k in kept[:3])
    assert 0 < sum(kept[3].values()) == sum(kept[4].values())
