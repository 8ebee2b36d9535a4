"""BPE encoding and decoding of whole texts by tree concatenation.

A long text is halved until its leaves are short; leaves are encoded on their own, and each join of
two halves re-encodes a window around the cut, growing it until both sides agree exactly:

* Between pre-token pieces. The pre-tokenizer matches from left to right, without memory, and looks
  at most two characters beyond a match. So the left half's piece ends up to three characters before
  the cut hold in the joined text, and from the first piece end that window and right half share,
  the right half's pieces hold too.
* Inside a piece that the pre-tokenizer doesn't split. A token sequence is the BPE encoding of its
  bytes if each pair of neighbours is the encoding of the pair's bytes. A window whose outer tokens
  equal those of the halves thus gives the exact encoding. Leaves go to the library as one batch,
  which its threads encode in parallel.

The same piece always has the same ids, so each worker remembers pieces, up to a bound; when that is
reached, those in use since the time before are kept.

Defined results: a null text is encoded as the empty one (no ids); special tokens written in a text
get their id, as in the library's default; rows that repeat are encoded each.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# The byte-level pre-tokenizer's pattern, as its public definition has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Blocks whose classes are the same in all Unicode versions in use; texts with other characters are pre-tokenized by the library.
SETTLED = r"[\x00-\x1b\x20-\x7f\xa0-ɏΑ-Ρα-ωА-я‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]*"

#: How far before a cut the piece ends of the left half are certain.
MARGIN = 3


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class TreeCodec:
    """Encoder and decoder for one byte-level BPE file of the tokenizers library.

    leaf: characters of text that are pre-tokenized at once. piece_leaf: bytes of an unsplit piece
    that are encoded at once. remembered: pieces in a worker's cache,
    beside which it keeps the one before.
    """

    def __init__(self, path: str, leaf: int = 4096, piece_leaf: int = 512, remembered: int = 250_000):
        self.leaf, self.piece_leaf, self.remembered = max(leaf, 2), max(piece_leaf, 2), remembered
        whole = Tokenizer.from_file(path)
        whole.no_truncation(), whole.no_padding()
        self.split_rare = whole.pre_tokenizer.pre_tokenize_str
        self.model = Tokenizer(whole.model)  # neither pre-tokenizer nor special tokens
        with open(path, encoding="utf-8") as f:
            self.special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern, self.settled = regex.compile(PATTERN), regex.compile(SETTLED)
        self.mapped = byte_characters()
        back = {c: b for b, c in enumerate(self.mapped)}
        self.token_bytes = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in self.model.get_vocab().items()}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.token_bytes}
        self.from_latin = {b: c for b, c in enumerate(self.mapped) if ord(c) != b}
        self.cache: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}  # the last full cache: what is still in use comes back from it

    # ---- pieces of a text

    def split(self, text: str) -> list[str]:
        """The pieces of a text, matched from its start."""
        if self.settled.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.split_rare(text)]

    def pieces(self, text: str) -> list[str]:
        """The same pieces, by halves."""
        if len(text) <= self.leaf:
            return self.split(text)
        cut = len(text) // 2
        return self.join_pieces(self.pieces(text[:cut]), self.pieces(text[cut:]))

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        sure, beyond = len(left), 0
        while sure and beyond < MARGIN:
            sure -= 1
            beyond += len(left[sure])
        back, reach = 2, 32
        while True:
            keep = max(0, sure - back)
            head, tail, taken = "".join(left[keep:]), [], 0
            right_ends = {(at := len(head)): 0}
            while taken < len(right) and at < len(head) + reach:
                tail.append(right[taken])
                at += len(right[taken])
                taken += 1
                right_ends[at] = taken
            window = self.split(head + "".join(tail))
            if window[: sure - keep] == left[keep:sure] or not keep:
                if taken == len(right):
                    return left[:keep] + window
                end = 0
                for n, x in enumerate(window):
                    end += len(x)
                    if end in right_ends and end <= at - MARGIN:
                        return left[:keep] + window[: n + 1] + right[right_ends[end] :]
            back, reach = back * 2, reach * 2

    # ---- tokens of a piece

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            window = self.model.encode(self.written(a + b), add_special_tokens=False).ids
            if (len(a) == len(left) or window[:1] == a[:1]) and (len(b) == len(right) or window[-1:] == b[-1:]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def written(self, ids: list[int]) -> str:
        return "".join(self.mapped[x] for i in ids for x in self.token_bytes[i])

    def encode_piece(self, mapped: str) -> list[int]:
        """Ids of one unsplit piece, by halves: all leaves in one batch, then joins level by level."""
        n = -(-len(mapped) // self.piece_leaf)
        count = 1 << (n - 1).bit_length()
        cuts = [len(mapped) * k // count for k in range(count + 1)]
        level = [x.ids for x in self.model.encode_batch([mapped[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)]
        while len(level) > 1:
            level = [self.join_tokens(a, b) for a, b in zip(level[::2], level[1::2])]
        return level[0]

    def learn(self, new: list[str]) -> None:
        """Puts pieces in the cache: their ids in decimal, joined by commas, and the bytes that these decode to."""
        encoded = b"\xff".join([x.encode("utf-8", "surrogatepass") for x in new])  # no UTF-8 text has this byte
        mapped = encoded.decode("latin-1").translate(self.from_latin).split(self.mapped[255])
        long = {k for k, x in enumerate(mapped) if len(x) > self.piece_leaf}
        ids = [e.ids for e in self.model.encode_batch_fast([x for k, x in enumerate(mapped) if k not in long] if long else mapped, add_special_tokens=False)]
        for k in sorted(long):
            ids.insert(k, self.encode_piece(mapped[k]))
        decimal, raw = self.decimal, self.token_bytes
        self.cache.update(zip(new, [(",".join([decimal[i] for i in own]), b"".join([raw[i] for i in own])) for own in ids]))

    # ---- texts

    def encode_texts(self, texts: Iterable[str]) -> list[tuple[str, bytes]]:
        """For each text: its ids in decimal, joined by commas, and the bytes that they decode to."""
        at_special, special = self.at_special, self.special
        split: list[list[list[str] | str]] = []  # pieces, or a special token
        for text in texts:
            parts = at_special.split(text) if at_special and at_special.search(text) else [text]
            split.append([x if x in special else self.pieces(x) for x in parts if x])
        new = {x for parts in split for pieces in parts if type(pieces) is list for x in set(pieces).difference(self.cache)}
        if len(self.cache) + len(new) > self.remembered:
            self.older, self.cache = self.cache, {}
            new = {x for parts in split for pieces in parts if type(pieces) is list for x in pieces}
        if again := new & self.older.keys():
            self.cache.update(zip(again, map(self.older.__getitem__, again)))
            new -= again
        if new:
            self.learn(list(new))
        cache, out = self.cache, []
        for parts in split:
            found = []
            for x in parts:
                found += [cache[p] for p in x] if type(x) is list else [(str(special[x]), x.encode())]
            ids, raw = zip(*found) if found else ((), ())
            out.append((",".join(ids), b"".join(raw)))
        return out

    def encode(self, text: str) -> list[int]:
        ids = self.encode_texts([text])[0][0]
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids: Iterable[int]) -> str:
        """Unknown ids are left out, broken UTF-8 is replaced, special tokens are written out."""
        return b"".join(self.token_bytes.get(i, b"") for i in ids).decode("utf-8", "replace")


_codecs: dict[tuple, TreeCodec] = {}


def codec(path: str, **options: int) -> TreeCodec:
    """One codec for each worker process and set of options."""
    os.environ.setdefault("RAYON_NUM_THREADS", "2")  # the library's threads in each worker
    key = (path, *sorted(options.items()))
    if key not in _codecs:
        _codecs[key] = TreeCodec(path, **options)
    return _codecs[key]


def _mapped(docs: DataFrame, id_col: str, text_col: str, find_path: Callable[[], str], options: dict, schema: str, rows: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(find_path(), **options)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield rows(own, part.column(0), [x or "" for x in part.column(1).to_pylist()])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def as_ids(decimal: str) -> np.ndarray:
    return np.fromstring(decimal, np.int32, sep=",") if decimal else np.zeros(0, np.int32)


def encode_documents(docs: DataFrame, find_path: Callable[[], str], id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """doc_id, ids array<int>, decoded string. find_path: called on the workers, gives the vocabulary file's place there."""

    def rows(own: TreeCodec, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        out = own.encode_texts(texts)
        return pa.RecordBatch.from_arrays([ids, pa.array([as_ids(s) for s, _ in out], pa.list_(pa.int32())), pa.array([raw.decode("utf-8", "replace") for _, raw in out], pa.string())], ["doc_id", "ids", "decoded"])

    return _mapped(docs, id_col, text_col, find_path, options, "doc_id long, ids array<int>, decoded string", rows)


def encode_digests(docs: DataFrame, find_path: Callable[[], str], id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **options: int) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text); with_ids: and ids array<int>."""

    def rows(own: TreeCodec, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        out = own.encode_texts(texts)
        columns = {
            "doc_id": ids,
            "n_tokens": pa.array([s.count(",") + 1 if s else 0 for s, _ in out], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(s.encode()).hexdigest() for s, _ in out], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest() for _, raw in out], pa.string()),
        }
        if with_ids:
            columns["ids"] = pa.array([as_ids(s) for s, _ in out], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _mapped(docs, id_col, text_col, find_path, options, schema, rows)
