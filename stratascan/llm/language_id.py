"""Language identification by a bidirectional gated recurrent network over bytes.

The sequence is the document itself, in UTF-8, as it is: letters, digits, marks and spaces. One
network reads it forwards, one backwards, and every byte gets a probability for each language from
both states; a document's probabilities are the mean over all its bytes. So that documents of any
length run in batches of one shape, a text is read in windows of CORE bytes, with CONTEXT bytes
before (forwards) or after (backwards) that only warm up the state; every byte is labelled once.

Training is numpy, by backpropagation through time with Adam, on pieces of PIECE bytes: PIECES of
them from all over the text of at most PER_LANGUAGE documents for each language, SAMPLE documents
in all (but one a language at least). Only those pieces are on the driver.

Defined results: a text that is null or has no letter is `und` with score 0; without training rows
all are; ties go to the first language in code point order; rows that repeat get equal results; more than
MOST_LANGUAGES languages are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_LANGUAGE, SAMPLE, PIECES, PIECE, MOST_LANGUAGES = 400, 20_000, 16, 64, 10_000
CORE, CONTEXT = 128, 16
ROWS = 512  # windows that run at once
LETTER = re.compile(r"[^\W\d_]+")


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() or any(map(str.isalpha, m.group())) for m in LETTER.finditer(text or ""))


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def as_bytes(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Positions x pieces of byte values, zero-padded, and which positions are real."""
    lengths = np.array(list(map(len, pieces)))
    longest = int(lengths.max())
    x = np.frombuffer(b"".join(p.ljust(longest, b"\0") for p in pieces), np.uint8).reshape(len(pieces), longest)
    return np.ascontiguousarray(x.T), np.arange(longest)[:, None] < lengths


def windows(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The documents' bytes with room around them, which of these are real, where each window starts, and its document.

    A window has CONTEXT positions, CORE of its own and CONTEXT more; the cores tile each document.
    """
    spans = np.array([-(-len(r) // CORE) * CORE for r in raws])
    edge = bytes(CONTEXT)
    joined = b"".join([edge + r.ljust(n, b"\0") + edge for r, n in zip(raws, spans)])
    real = b"".join([edge + (b"\1" * len(r)).ljust(n, b"\0") + edge for r, n in zip(raws, spans)])
    begin = np.cumsum(spans + 2 * CONTEXT) - spans - 2 * CONTEXT
    starts = np.concatenate([np.arange(0, n, CORE) + at for n, at in zip(spans, begin)])
    return np.frombuffer(joined, np.uint8), np.frombuffer(real, bool), starts, np.repeat(np.arange(len(raws)), spans // CORE)


class BiGru:
    """Parameters and passes of the network. Gates lie in the order update, reset, candidate."""

    def __init__(self, languages: list[str], hidden: int = 12, seed: int = 3):
        self.languages, self.hidden = languages, hidden
        rng = np.random.default_rng(seed)
        init = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = init(256, 3 * hidden, scale=0.3)
            self.p[f"u{d}"] = init(hidden, 3 * hidden, scale=hidden**-0.5)
            self.p[f"c{d}"] = np.zeros(3 * hidden, np.float32)
        self.p["o"] = init(2 * hidden, len(languages), scale=(2 * hidden) ** -0.5)
        self.p["q"] = np.zeros(len(languages), np.float32)

    def run(self, d: str, x: np.ndarray, real: np.ndarray, steps: list | None = None) -> np.ndarray:
        """States after each position of x, read from its start ("f") or its end ("b"); zero where it is not real."""
        n, u = self.hidden, self.p[f"u{d}"]
        table = self.p[f"x{d}"] + self.p[f"c{d}"]
        gates_in, cand_in = np.ascontiguousarray(table[:, : 2 * n]), np.ascontiguousarray(table[:, 2 * n :])
        h = np.zeros((x.shape[1], n), u.dtype)
        states = np.empty((*x.shape, n), u.dtype)
        whole = real.all(axis=1)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            s = h @ u
            gates = gates_in[x[t]]
            gates += s[:, : 2 * n]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:, :n], gates[:, n:]
            cand = cand_in[x[t]]
            cand += r * s[:, 2 * n :]
            np.tanh(cand, out=cand)
            if steps is not None:
                steps.append((t, h, z, r, cand, s[:, 2 * n :]))
            h = h - cand
            h *= z
            h += cand
            if not whole[t]:
                h *= real[t][:, None]
            states[t] = h
        return states

    def back(self, d: str, x: np.ndarray, real: np.ndarray, steps: list, grad: np.ndarray, out: dict[str, np.ndarray]) -> None:
        """Adds to out the gradients of one direction, given those of its states."""
        n, u = self.hidden, self.p[f"u{d}"]
        da = np.empty((*x.shape, 3 * n), u.dtype)
        du, carry = np.zeros_like(u), np.zeros(grad.shape[1:], u.dtype)
        for t, h, z, r, cand, s in reversed(steps):
            dh = (grad[t] + carry) * real[t][:, None]
            dc = dh * (1 - z) * (1 - cand * cand)
            dz = dh * (h - cand) * z * (1 - z)
            dr = dc * s * r * (1 - r)
            da[t] = np.concatenate([dz, dr, dc], axis=1)
            ds = np.concatenate([dz, dr, dc * r], axis=1)
            du += h.T @ ds
            carry = dh * z + ds @ u.T
        flat, dx = x.ravel(), np.empty_like(self.p[f"x{d}"])
        for k, column in enumerate(da.reshape(-1, 3 * n).T):
            dx[:, k] = np.bincount(flat, column, 256)
        out[f"x{d}"], out[f"u{d}"], out[f"c{d}"] = dx, du, da.sum(axis=(0, 1))

    def label(self, forwards: np.ndarray, backwards: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at each position, from its states."""
        n = self.hidden
        prob = forwards.reshape(-1, n) @ self.p["o"][:n]
        prob += backwards.reshape(-1, n) @ self.p["o"][n:]
        prob += self.p["q"]
        prob -= prob.max(axis=1, keepdims=True)
        np.exp(prob, out=prob)
        prob /= prob.sum(axis=1, keepdims=True)
        return prob.reshape(*forwards.shape[:2], -1)

    def positions(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Probabilities at every position of x."""
        return self.label(self.run("f", x, real), self.run("b", x, real))

    def gradients(self, x: np.ndarray, real: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients; labels: pieces x languages, each row sums to 1."""
        n = self.hidden
        steps_f, steps_b = [], []
        f, b = self.run("f", x, real, steps_f), self.run("b", x, real, steps_b)
        prob = self.label(f, b)
        count = real.sum()
        loss = -(np.log(prob + 1e-9) * labels[None] * real[:, :, None]).sum() / count
        d = ((prob - labels[None]) * real[:, :, None] / count).astype(f.dtype)
        flat = d.reshape(-1, d.shape[2])
        out = {"o": np.concatenate([f.reshape(-1, n).T @ flat, b.reshape(-1, n).T @ flat]), "q": flat.sum(axis=0)}
        both = d @ self.p["o"].T
        self.back("f", x, real, steps_f, both[:, :, :n], out)
        self.back("b", x, real, steps_b, both[:, :, n:], out)
        return float(loss), out

    def document_sums(self, raws: list[bytes]) -> np.ndarray:
        """Sums over each document's bytes of the languages' probabilities."""
        sums = np.zeros((len(raws), len(self.languages)))
        joined, real, starts, owner = windows(raws)
        for k in range(0, len(starts), ROWS):
            at = np.arange(CORE + 2 * CONTEXT)[:, None] + starts[k : k + ROWS]
            x, own = joined[at], real[at]
            # Each direction needs its context on one side only.
            f = self.run("f", x[:-CONTEXT], own[:-CONTEXT])[CONTEXT:]
            b = self.run("b", x[CONTEXT:], own[CONTEXT:])[:-CONTEXT]
            prob = self.label(f, b)
            prob *= own[CONTEXT:-CONTEXT, :, None]
            np.add.at(sums, owner[k : k + ROWS], prob.sum(axis=0))
        return sums


def train(samples: list[tuple[bytes, str]], hidden: int = 12, steps: int = 300, batch: int = 256, rate: float = 0.02, seed: int = 3) -> BiGru | None:
    """A network trained on (piece, language) rows, languages alike often; None without pieces."""
    samples = sorted({s for s in samples if s[0]}, key=lambda s: (s[1], s[0]))
    if not samples:
        return None
    languages = sorted({lang for _, lang in samples})
    column = np.array([languages.index(lang) for _, lang in samples])
    weight = 1 / np.bincount(column)[column] / len(languages)
    net = BiGru(languages, hidden, seed)
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        picked = rng.choice(len(samples), batch, p=weight)
        x, real = as_bytes([samples[k][0] for k in picked])
        _, grads = net.gradients(x, real, np.eye(len(languages), dtype=np.float32)[column[picked]])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g / max(1.0, norm)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            now = rate * (1 - step / (steps + 1)) + 0.001
            net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def predict(net: BiGru | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    out = [("und", 0.0)] * len(texts)
    known = [k for k, t in enumerate(texts) if net and has_letter(t)]
    if known:
        raws = [encoded(texts[k]) for k in known]
        for k, raw, total in zip(known, raws, net.document_sums(raws)):
            best = int(total.argmax())
            out[k] = (net.languages[best], min(1.0, float(total[best] / len(raw))))
    return out


def pieces_of(text: str | None, most: int = PIECES, size: int = PIECE) -> list[bytes]:
    """Pieces of a text's bytes, at places that its hash fixes, anywhere in it; all of a short text."""
    raw = encoded(text or "")
    if len(raw) <= most * size:
        return [raw[k : k + size] for k in range(0, len(raw), size)]
    places = np.random.default_rng(xxhash.xxh64_intdigest(raw)).integers(0, len(raw) - size + 1, most)
    return [raw[k : k + size] for k in sorted(places)]


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, may_learn: Column, per_language: int = PER_LANGUAGE) -> list[tuple[bytes, str]]:
    """(piece, language) of the per_language documents of each language whose ids hash lowest, fewer where SAMPLE is less than that for all."""
    text = F.col(text_col).cast("string")
    rows = docs.filter(may_learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.crc32(text.cast("binary"))).alias("h"), text.alias("text"))
    found = rows.select("lang").distinct().count()
    if found > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    each = max(1, min(per_language, SAMPLE // max(1, found)))
    lowest = lambda df, *order: df.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= each)  # cut before the shuffle, too
    last = F.broadcast(lowest(rows.select("lang", "h"), "h").groupBy("lang").agg(F.max("h").alias("last")))  # a row a language
    picked = lowest(rows.join(last, "lang").filter(F.col("h") <= F.col("last")), "h", "text").select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(p, lang) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in pieces_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in own], pa.binary()), pa.array([lang for _, lang in own], pa.string())], ["piece", "lang"])

    return [(bytes(r.piece), r.lang) for r in picked.mapInArrow(cut, "piece binary, lang string").collect()]


def identify(docs: DataFrame, net: BiGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (as it is), lang_pred, score for each row of docs."""
    kind = docs.select(F.col(id_col).alias("doc_id")).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = predict(net, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: BiGru | None, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that have a language with that score or more."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = predict(net, part.column(names.index(text_col)).to_pylist())
                yield part.filter(pa.array([x != "und" and s >= least for x, s in got], pa.bool_()))

    plain = docs.toDF(*[f"_{k}" for k in range(len(names))])  # mapInArrow looks columns up by name, and odd names mean other things there
    return plain.mapInArrow(run, plain.schema).toDF(*names)
