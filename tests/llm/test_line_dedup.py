import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stratascan.llm import common, line_dedup, queries


def brute(rows, least=8, least_line=None):
    """Repeats as (doc_id, start, end, kept doc_id, kept start), from boundaries in the text, by trying every pair of them."""
    at = defaultdict(set)
    least_line = least if least_line is None else least_line
    for i, text in rows:
        text = text or ""
        spans, lines = set(), {m.span() for m in re.finditer(r"[^\n]+", text)}
        sentences = []
        for m in re.finditer(r"[^.!?\n]+[.!?]*", text):
            words = list(re.finditer(r"\w+", m.group()))
            if len(words) > 24:
                ends = [w.end() for w in words if zlib.crc32(w.group().lower().encode()) % 8 == 0]
                ends = [e for e in ends if e != words[-1].end()] + [len(m.group())]
                if zlib.crc32(words[-1].group().lower().encode()) % 8 == 0:
                    ends[-1] = words[-1].end()
                sentences += [(m.start() + words[[w.start() >= a for w in words].index(True)].start(), m.start() + e) for a, e in zip([0, *ends], ends)]
            elif words:
                sentences.append(m.span())
        count = lambda a, b: len(re.findall(r"\w+", text[a:b].lower()))
        for k in range(len(sentences)):
            for j in range(k, len(sentences)):
                if count(sentences[k][0], sentences[j][1]) >= least:
                    spans.add((sentences[k][0], sentences[j][1]))
                    break
        for a, b in spans | lines:
            part = text[a:b]
            if count(a, b) >= least or (a, b) in lines and count(a, b) >= least_line and part.strip():
                s, e = a + len(part) - len(part.lstrip()), a + len(part.rstrip())
                at[" ".join(re.findall(r"\w+", part.lower())) or (" ".join(part.split()),)].add((i, s, e))
    out = set()
    for places in at.values():
        first = min((i, s) for i, s, _ in places)
        out |= {(*p, *first) for p in places if p[:2] != first}
    return out


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(2, 25))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(6))
    shared = [sentence() for _ in range(4)]
    rows = []
    for k in range(80):
        lines = [" ".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6))]
        if k % 9 == 0:
            lines[0] = "Some words before " + passage + " and after"
        if k % 3 == 0:
            lines.append("  " + rng.choice(shared) + " ")
        if k % 10 == 0:
            lines += [lines[0]]
        rows.append((k, "\n".join(lines)))
    unmarked = " ".join(word() for _ in range(55))
    rows += [(200 + k, " ".join([word() for _ in range(9 + k)] + [unmarked] + [word() for _ in range(12)])) for k in range(5)]
    short = " ".join(" ".join(word() for _ in range(n)).capitalize() + "." for n in (3, 4, 2, 5, 3, 6, 1, 4, 5, 3, 4, 6, 5))
    rows += [(300 + k, " ".join([word() for _ in range(4)] + [short] + [word() for _ in range(3)]).replace(". ", rng.choice([". ", ".\n"]))) for k in range(5)]
    return rows + [(100, None), (101, ""), (102, "\n \n"), (103, rows[5][1]), (104, rows[5][1].upper())], passage


def test_repeats_against_brute_force(spark):
    rows, passage = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, digest string")
    got = [(r.doc_id, r.start, r.end, r.kept_doc_id, r.kept_start) for r in line_dedup.repeated_units(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert {*range(9, 80, 9), *range(201, 205), *range(301, 305)} <= {g[0] for g in got}  # passages in the middle of lines, without marks, of short sentences


def test_cut_texts(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, end int, _id string")
    out = line_dedup.without_repeats(docs)
    assert out.columns == [*docs.columns, "removed"]
    spans = defaultdict(set)
    for i, s, e, *_ in brute(rows):
        spans[i] |= set(range(s, e))
    for r in out.collect():
        text = dict(rows)[r.doc_id]
        assert r.text == (None if text is None else "".join(c for k, c in enumerate(text) if k not in spans[r.doc_id]))
        assert {k for s in r.removed for k in range(s.start, s.end)} == spans[r.doc_id]


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(60000)) + " "
    docs = spark.createDataFrame([(1, long), (1, long), (None, long), (2, "short line")], "doc_id long, text string")
    got = line_dedup.repeated_units(docs).collect()
    assert [(r.doc_id, r.start, r.end, r.kept_doc_id) for r in got if r.unit == "line"] == [(1, 0, len(long) - 1, None)] * 2
    assert all(r.doc_id == 1 and r.kept_doc_id is None and r.start == r.kept_start for r in got)
    assert line_dedup.repeated_units(docs.filter("false")).count() == 0


def flat(rows):
    """Units of cut documents as those of brute()."""
    return {(r.doc_id, u.start, u.end, u.kept_doc_id, u.kept_start) for r in rows for u in r.units}


def test_query_hashes_every_line(spark, tmp_path):
    cjk = "今日は天気が良いので散歩に出かけました"
    texts = ["All rights reserved.\nown one", f"own two\n all rights, reserved\n{cjk}\n---", f"{cjk}\n\nown three\n---\nbuy now cheap", "buy now cheap", "x\nBuy now, cheap!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op3_line_dedup(spark, str(tmp_path)).collect()
    got = {(i, texts[i][s:e], k, at) for i, s, e, k, at in flat(rows)}
    assert got == {(1, "all rights, reserved", 0, 0), (2, cjk, 1, 30), (2, "---", 1, 31 + len(cjk)), (3, "buy now cheap", 2, texts[2].index("buy")), (4, "Buy now, cheap!", 2, texts[2].index("buy"))}
    left = {1: f"own two\n \n{cjk}\n---", 2: "\n\nown three\n\nbuy now cheap", 3: "", 4: "x\n"}
    assert {r.doc_id: (r.n_chars, r.n_left, r.left_sha256) for r in rows} == {i: (len(texts[i]), len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in left.items()}


def test_two_texts_of_one_id_are_two_documents(spark):
    """Spans are cut from the text that they were found in, from no other with its doc_id, null ones too."""
    line = "this is a line of more than eight words which repeats"
    other = "nothing in this text repeats anywhere else, it is as long as that, and one more line"
    rows = [(1, line), (2, f"{line}\nand own"), (2, other), (None, other + " x"), (None, f"only here\n{other} y"), (3, line), (3, f"zz {line}"), (3, line)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")
    out = Counter((r.doc_id, r.text) for r in line_dedup.without_repeats(docs, least_line=0).collect())
    assert out == Counter([(1, line), (2, "\nand own"), (2, other), (None, other + " x"), (None, f"only here\n{other} y"), (3, ""), (3, f"zz {line}"), (3, "")])
    cut = line_dedup.cut_documents(docs, least_line=0).collect()
    assert Counter((r.doc_id, r.text) for r in cut) == Counter([(2, "\nand own"), (3, ""), (3, "")])


def test_a_line_in_every_document_and_a_row_that_repeats(spark):
    """Hot digests and hot rows: no results change, and they aren't dealt by their digest or key."""
    rows = [(k, f"the same line is in every one of these documents\nown {k}") for k in range(3000)] + [(5000, "a row that repeats in full, with two lines\nthe same line is in every one of these documents")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.all_units(docs, least_line=0)
    assert set(common.hot_values(found, "d1")) == {r.d1 for r in found.groupBy("d1").count().filter("count >= 3000").collect()}
    out = line_dedup.cut_documents(docs, least_line=0)
    assert out.groupBy("n_chars", F.col("doc_id") == 5000).count().count() > 1 and out.count() == 2999 + 3000
    assert out.filter("doc_id = 5000").select("text").distinct().collect() == [("a row that repeats in full, with two lines\n",)]
