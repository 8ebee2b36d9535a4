import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratascan.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
WHOLE.no_truncation(), WHOLE.no_padding()
CODECS = [bpe.TreeCodec(PATH, leaf=leaf, piece_leaf=piece, remembered=50) for leaf, piece in ((7, 3), (64, 16), (4096, 512))]


def direct(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \n\t'srevmldtaé0１,.!中​\x85\x1c　<|>zQ"), max_size=120))
def test_small_leaves_equal_the_library(text):
    for codec in CODECS:
        assert codec.encode(text) == direct(text)
        assert codec.decode(codec.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_unicode(text):
    for codec in CODECS:
        assert codec.encode(text) == direct(text)


@pytest.mark.parametrize("alphabet", ["a", "ab", "the in g", "=-", " ", "\n ", "0123456789", "éçà", "abcdefghijklmnopqrstuvwxyz", "中文字", "'re'll"])
def test_long_unsplit_pieces(alphabet):
    rng = random.Random(5)
    text = "".join(rng.choice(alphabet.replace(" ", "") or " ") for _ in range(5000))
    spaced = "".join(rng.choice(alphabet) for _ in range(9000))
    for t in (text, spaced):
        want = direct(t)
        for codec in CODECS:
            assert codec.encode(t) == want


def test_every_character_class():
    text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}." for c in range(0x3400) if not 0xD800 <= c < 0xE000)
    assert CODECS[2].encode(text) == direct(text)
    for c in range(0x3400):
        part = f"a{chr(c)}1{chr(c)} {chr(c)}.  {chr(c)}"
        assert CODECS[2].encode(part) == direct(part), hex(c)


def test_special_tokens_in_text():
    text = "one<|endoftext|> two<|endoftext|><|endoftext|>"
    assert CODECS[0].encode(text) == direct(text)
    assert CODECS[0].decode(direct(text)) == WHOLE.decode(direct(text), skip_special_tokens=False)


def test_documents(spark):
    texts = ["", None, "word " * 3000, "x" * 20000, "same", "same", "  \n\n  it's"]
    docs = spark.createDataFrame([(k, t, "decoded") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.encode_digests(docs, lambda: PATH, leaf=64, piece_leaf=32).collect()}
    full = {r.doc_id: r for r in bpe.encode_documents(docs, lambda: PATH).collect()}
    for k, t in enumerate(texts):
        ids = direct(t or "")
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert (full[k].ids, full[k].decoded) == (ids, t or "")
    assert bpe.encode_digests(docs.filter("false"), lambda: PATH).count() == 0
