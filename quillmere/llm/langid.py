"""Language identification with error-correcting output codes.

Each language has a codeword of bits; each bit has its own binary classifier over hashed character n-grams.
A text's language is the one whose codeword has the smallest loss, summed over bits by how sure each
classifier is, not by counting wrong bits; texts whose two best codewords are close are flagged.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_rows, read_table, text_chunks

#: Hashed n-gram features (letters alone, pairs and triples with word ends).
BUCKETS = 1 << 13
#: Labelled documents to learn from, at most; what the driver gets is this many vectors of BUCKETS bytes.
MAX_TRAIN_DOCS = 3_000
#: Below this gap between the two best languages' shares a text counts as ambiguous.
AMBIGUOUS_GAP = 0.2
STEPS, RIDGE = 150, 1e-5
#: Longest code; beyond exhaustive codes, random ones of this many bits a language doubling.
BITS_PER_DOUBLING = 12


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A ``classes`` by bits matrix of -1 and 1. Up to 5 classes exhaustive (every split once, Dietterich and Bakiri
    1995), else the best of several random codes by smallest Hamming distance between rows."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 5:
        splits = [(1, *s) for s in itertools.product((1, -1), repeat=classes - 1) if -1 in s]
        return np.array(splits, float).T
    bits = int(np.ceil(BITS_PER_DOUBLING * np.log2(classes)))
    rng, best, width = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice((-1.0, 1.0), (classes, bits))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        apart = min(int((code[a] != code[b]).sum()) for a, b in itertools.combinations(range(classes), 2))
        if apart > width:
            best, width = code, apart
    return best


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, one after the other, with every sign that is not a letter as one 0, and each text's start."""
    parts = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    table = _letter_table()
    letter = table[np.minimum(codes, len(table) - 1)] | (codes >= len(table))
    return np.where(letter, codes, 0).astype(np.uint32), starts


_tables: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _tables:
        _tables.append(np.array([chr(c).isalpha() for c in range(0x3000)]))
    return _tables[0]


def features(texts: list[str], buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """For each text its n-gram counts, square-rooted and scaled to length one; zeros where it has no letter."""
    if not texts:
        return
    codes, starts = _letters(texts)
    none = np.zeros(2, np.uint32)
    a, b, c = codes, np.append(codes[1:], none[:1]), np.append(codes[2:], none)[: len(codes)]
    shift = np.uint32(32 - buckets.bit_length() + 1)
    mixed = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)
    triple = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
    two = a * np.uint32(0x27D4EB2F) + b * np.uint32(0x165667B1)
    pair = ((two ^ (two >> np.uint32(15))) * np.uint32(0x297A2D39)) >> shift
    some = a != 0
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        held = some[s:e]
        n = np.bincount(triple[s:e][held], minlength=buckets) + np.bincount(pair[s:e][held], minlength=buckets)
        v = np.sqrt(n.astype(np.float32))
        size = float(np.sqrt(v @ v))
        yield v / size if size else v


def train(labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> dict:
    """Learn from at most ``max_docs`` rows of ``(text, lang)``, of each language an equal share (``bounded_rows``); rows with a null are left out.

    The vectors are made by Spark; the driver gets one of fixed size for each of the bounded rows. Of more languages than
    ``max_docs`` those with most rows are learned.
    """
    rows = bounded_rows(labelled.where("text is not null and lang is not null").select("text", "lang"), max_docs, "lang")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, 4 << 20):
            found = [np.round(v * 255).astype(np.uint8).tobytes() for v in features(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("lang")], names=["v", "lang"])

    got = rows.mapInArrow(make, "v binary, lang string").collect()
    langs = sorted({r.lang for r in got})
    if not langs:
        return {"langs": ["und"], "code": np.ones((1, 1)), "w": np.zeros((BUCKETS + 1, 1), np.float32)}
    got.sort(key=lambda r: (r.lang, bytes(r.v)))
    x = np.frombuffer(b"".join(bytes(r.v) for r in got), np.uint8).reshape(len(got), BUCKETS).astype(np.float32) / 255
    label = np.array([langs.index(r.lang) for r in got])
    code = codewords(len(langs))
    share = 1 / np.bincount(label, minlength=len(langs))[label]  # each language counts alike
    return {"langs": langs, "code": code, "w": _fit(x, code[label], share / share.sum())}


def _fit(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """One ridge logistic regression for each column of ``y``, all at once, by Adam."""
    w = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        miss = -y * share[:, None] / (1 + np.exp(np.clip(y * (x @ w[:-1] + w[-1]), -30, 30)))
        g = np.vstack([x.T @ miss.astype(np.float32) + RIDGE * w[:-1], miss.sum(axis=0)[None]]).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return w


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss-weighted decoding: each language's summed logistic loss, as shares, and the losses."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None, :, :]).sum(axis=2)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return share / share.sum(axis=1, keepdims=True), loss


def language_id(docs: DataFrame, trained: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: the columns in ``keep``, ``lang_pred``, ``score``, ``second``, ``ambiguous``.

    A text that is null or has no letter gets ``und`` with score 0. Other columns, also of the same names, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, code, w = np.array(trained["langs"], object), trained["code"], trained["w"]
        for batch in text_chunks(batches, 2 << 20, "_text"):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            margins = np.zeros((len(texts), code.shape[1]))
            empty = np.zeros(len(texts), bool)
            for k, v in enumerate(features(texts)):
                empty[k] = not v.any()
                margins[k] = v @ w[:-1] + w[-1]
            share, _ = decode(margins, code)
            order = np.argsort(-share, axis=1, kind="stable")
            at = np.arange(len(texts))
            best = share[at, order[:, 0]]
            other = share[at, order[:, 1]] if len(langs) > 1 else np.zeros(len(texts))
            second = langs[order[:, 1]] if len(langs) > 1 else np.full(len(texts), None, object)
            made = [
                pa.array(np.where(empty, "und", langs[order[:, 0]]).tolist(), pa.string()),
                pa.array(np.where(empty, 0.0, best), pa.float64()),
                pa.array([None if e else x for e, x in zip(empty, second, strict=True)], pa.string()),
                pa.array(empty | (best - other < AMBIGUOUS_GAP)),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "lang_pred", "score", "second", "ambiguous"])

    kept = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string, score double, second string, ambiguous boolean"])
    return docs.select(*keep, docs["text"].alias("_text")).mapInArrow(run, schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language_id(docs, train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "second", "ambiguous")
