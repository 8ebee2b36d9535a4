import random

import numpy as np
from pyspark.sql import functions as F

from stratascan.llm import language_id as lid

RNG = random.Random(2)
PARTS = {"xx": ["tion", "the", "ing", "ough", "sh"], "yy": ["ción", "ñe", "que", "lla", "os"], "zz": ["язы", "ко", "вед", "ние", "ст"]}


def text(lang, n=40):
    return " ".join("".join(RNG.choice(PARTS[lang]) for _ in range(RNG.randint(1, 4))) for _ in range(n)).capitalize() + ". 42!"


def test_gradients_match_differences():
    net = lid.BiGru(["a", "b", "c"], hidden=4, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, real = lid.as_bytes(["ab".encode(), " é ".encode(), b"abcdefg", b"x"])
    labels = np.array([[1, 0, 0], [0, 0.5, 0.5], [0, 0, 1], [0, 1, 0]], float)
    _, grads = net.gradients(x, real, labels)
    rng = np.random.default_rng(0)
    for k, p in net.p.items():
        at = [tuple(rng.integers(0, s) for s in p.shape) for _ in range(6)] if not k.startswith("x") else [(b, j) for b in (32, 97, 0xA9) for j in (0, 5, 11)]
        for i in at:
            old = p[i]
            p[i] = old + 1e-3
            up = net.gradients(x, real, labels)[0]
            p[i] = old - 1e-3
            down = net.gradients(x, real, labels)[0]
            p[i] = old
            assert abs((up - down) / 2e-3 - grads[k][i]) < 2e-4, (k, i)


def slow_positions(net, raw):
    """One document, one byte at a time, over its whole length."""
    n, sig = net.hidden, lambda v: 1 / (1 + np.exp(-v))
    states = {}
    for d, order in (("f", range(len(raw))), ("b", range(len(raw) - 1, -1, -1))):
        h, states[d] = np.zeros(n), {}
        for t in order:
            a, s = net.p[f"x{d}"][raw[t]] + net.p[f"c{d}"], h @ net.p[f"u{d}"]
            z, r = sig(a[:n] + s[:n]), sig(a[n : 2 * n] + s[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * s[2 * n :])
            states[d][t] = h
    logits = np.array([np.concatenate([states["f"][t], states["b"][t]]) @ net.p["o"] + net.p["q"] for t in range(len(raw))])
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def test_windows_label_every_byte_as_the_whole_document_does():
    net = lid.train([(p, lang) for lang in PARTS for k in range(30) for p in lid.pieces_of(text(lang))], hidden=6, steps=60)
    raws = [text(lang, n).encode() for lang, n in (("xx", 1), ("yy", 5), ("zz", 90), ("xx", 400))] + [b"a" * lid.CORE, b"b" * (lid.CORE + 1), b"c"]
    for raw, total in zip(raws, net.document_sums(raws)):
        want = slow_positions(net, raw)
        assert abs(total.sum() - len(raw)) < 1e-2  # every byte once
        if len(raw) <= lid.CORE:  # one window: exactly the network over the whole text
            assert np.allclose(total, want.sum(0), atol=1e-3)
        assert np.allclose(total / len(raw), want.mean(0), atol=0.05) and total.argmax() == want.sum(0).argmax()
    joined, real, starts, owner = lid.windows(raws)
    for k, raw in enumerate(raws):
        cores = [joined[s + lid.CONTEXT : s + lid.CONTEXT + lid.CORE][real[s + lid.CONTEXT : s + lid.CONTEXT + lid.CORE]] for s in starts[owner == k]]
        assert b"".join(c.tobytes() for c in cores) == raw


def test_batches_and_repeats_change_nothing():
    net = lid.BiGru(["a", "b"], hidden=4, seed=1)
    texts = ["a bcd", "éé longerword a", None, "中文 a", "x " * 70_000, "a bcd"]
    together = lid.predict(net, texts)
    assert together[0] == together[-1]
    for t, (lang, score) in zip(texts, together):
        alone = lid.predict(net, [t])[0]
        assert alone[0] == lang and abs(alone[1] - score) < 1e-5


def test_context_reaches_over_spaces_digits_and_marks():
    """What stands before or after a space or a mark changes how the bytes beyond it are labelled."""
    net = lid.BiGru(["a", "b", "c"], hidden=6, seed=5)
    label = lambda raw: net.positions(*lid.as_bytes([raw]))[:, 0]
    one, other = label(b"tion que, 12"), label(b"que tion, 12")
    assert not np.allclose(one[8:], other[8:], atol=1e-3)  # ", 12": the same bytes after other words
    assert not np.allclose(label(b"que 1.")[:3], label(b"que 7!")[:3], atol=1e-4)


def test_letters():
    assert [lid.predict(lid.BiGru(["a"], 2), [t])[0][0] for t in ("42 ² _ ¼", None, "", "The", "² é", "1x")] == ["und", "und", "und", "a", "a", "a"]


def test_pieces():
    assert lid.pieces_of(None) == [] == lid.pieces_of("")
    raw = text("yy", 5000).encode()
    assert b"".join(lid.pieces_of(raw[:900].decode(errors="ignore"))) == raw[:900].decode(errors="ignore").encode()
    pieces = lid.pieces_of(raw.decode())
    assert len(pieces) == lid.PIECES and all(len(p) == lid.PIECE and p in raw for p in pieces) and pieces == lid.pieces_of(raw.decode())
    assert max(raw.find(p) for p in pieces) > len(raw) // 2  # from all over the text


def test_many_languages_share_the_sample(spark):
    docs = spark.createDataFrame([(k, f"word{k}", f"l{k % 50:02}") for k in range(400)] + [(7, "same", "l07")] * 300, "doc_id long, text string, lang string")
    got = lid.training_sample(docs, "doc_id", "text", "lang", F.lit(True), per_language=3)
    assert {lang for _, lang in got} == {f"l{k:02}" for k in range(50)}
    assert len(got) == 150 and sorted(got) == sorted(lid.training_sample(docs, "doc_id", "text", "lang", F.lit(True), per_language=3))


def test_held_out_accuracy_and_edges(spark):
    rows = [(k, text(lang), lang, 0.5) for k, lang in enumerate(list(PARTS) * 120)]
    edge = [(1000, None, "xx", 0.1), (1001, "", None, 0.1), (1002, "12 !?", None, 0.1), (1003, text("zz", 30000), None, 0.1), (None, text("yy"), None, 0.1), (7, text("xx"), "xx", 0.2)]
    docs = spark.createDataFrame(rows + edge, "doc_id long, text string, lang string, score double")
    net = lid.train(lid.training_sample(docs, "doc_id", "text", "lang", F.col("doc_id") % 4 != 2, per_language=60), steps=120)
    assert net.languages == ["xx", "yy", "zz"]
    got = {r.doc_id: r for r in lid.identify(docs, net).collect()}
    right = [got[k].lang_pred == lang for k, _, lang, _ in rows if k % 4 == 2 and k != 7]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "zz", "yy"]
    kept = lid.keep_identified(docs, net)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 3
    assert lid.identify(docs.filter("false"), net).count() == 0
    none = lid.train(lid.training_sample(docs.filter("false"), "doc_id", "text", "lang", F.lit(True)))
    assert none is None and {r.lang_pred for r in lid.identify(docs, none).collect()} == {"und"}
