"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are those of the line itself and of its two neighbours, and two
labels in a row have a weight of their own. Forward and backward passes give each line's marginal; a document's
quality is the mean of them weighted by the lines' lengths, calibrated on labelled documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_ids, bounded_rows, materialize, read_table, text_chunks

#: Labelled documents to learn from, at most, and lines of them that the fit uses: documents of more than a tenth of these
#: lines are not learned from, and where the rest has more lines, fewer documents are. Scoring always reads every line.
MAX_TRAIN_DOCS = 4_000
MAX_TRAIN_LINES = 200_000
STEPS, RIDGE = 200, 1e-4
OWN = 13


def split_lines(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All lines that are not blank, in order, and how many each text has."""
    lines, counts = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        own = [x for x in t.split("\n") if x.strip()]
        lines += own
        counts[k] = len(own)
    return lines, counts


def line_statistics(lines: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``OWN`` numbers for each line, from its characters and from whether the text has had it before; and its length."""
    n = len(lines)
    x = np.zeros((n, OWN), np.float32)
    if not n:
        return x, np.zeros(0)
    sizes = np.array([len(s) for s in lines], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    codes = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "replace"), np.uint32)
    kind = _kinds()[np.minimum(codes, 0x2FFF)]
    after = np.append(kind[1:], kind[:1] * 0)
    share = lambda mask: np.add.reduceat(mask, starts, dtype=np.int32) / np.maximum(1, sizes)
    letter = (kind == 1) | (kind == 2)
    words = np.maximum(1, np.add.reduceat((kind != 0) & (after == 0), starts, dtype=np.int32))
    letters = np.add.reduceat(letter, starts, dtype=np.int32)
    x[:, 0] = 1
    x[:, 1] = np.log1p(sizes) / 5
    x[:, 2] = np.add.reduceat(kind == 2, starts, dtype=np.int32) / np.maximum(1, letters)  # capitals
    x[:, 3] = share(kind == 3)  # digits
    x[:, 4] = share(kind == 4)  # full stops, commas and quotes
    x[:, 5] = share(kind == 5)  # other signs
    x[:, 6] = np.add.reduceat((kind == 5) & (after == 5), starts, dtype=np.int32) / words  # signs in a row, a word
    x[:, 7] = np.minimum(letters / words, 20) / 10  # word length
    x[:, 8] = np.minimum(words, 200) / 100
    last = kind[starts + sizes - 1]
    x[:, 9] = last == 4
    x[:, 10] = kind[starts] == 2
    doc = np.repeat(np.arange(len(counts)), counts)
    key = np.fromiter(map(hash, zip(doc.tolist(), lines, strict=True)), np.int64, n)
    order = np.argsort(key, kind="stable")
    again = np.zeros(n, bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    x[:, 11] = again  # the text has had this line before
    x[:, 12] = share(kind == 6)  # bars and other column marks
    return x, sizes.astype(float)


_tables: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """0 white space, 1 letter, 2 capital, 3 digit, 4 prose sign, 5 other sign, 6 column mark."""
    if not _tables:
        t = np.full(0x3000, 5, np.uint8)
        for code in range(0x3000):
            c = chr(code)
            t[code] = 0 if c.isspace() else 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:?'\"-()’“”¿¡" else 6 if c in "|\t" else 5
        t[0x2FFF] = 1
        _tables.append(t)
    return _tables[0]


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's numbers, those of the line before and of the line after (zeros beyond a text's ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.cumsum(counts)
    firsts = (ends - counts)[counts > 0]
    before[firsts] = 0
    after[ends[counts > 0] - 1] = 0
    return np.hstack([x, before, after])


def marginals(emit: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward for many chains side by side. ``emit``: lines by 2 log weights; ``trans``: 2 by 2.
    Returns each line's label marginals, the summed pair marginals (2 by 2), and the summed log partition."""
    p, pairs, log_z = np.zeros_like(emit), np.zeros((2, 2)), 0.0
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")  # the longest first: at step t the running ones are a prefix
    order = order[counts[order] > 0]
    if not len(order):
        return p, pairs, 0.0
    n, s = counts[order], starts[order]
    alive = [int(k) for k in np.searchsorted(-n, -np.arange(n[0]), side="left")]
    fwd = np.zeros_like(emit)
    fwd[s] = emit[s]
    for t in range(1, int(n[0])):
        at = s[: alive[t]] + t
        b = fwd[at - 1]
        fwd[at] = emit[at] + np.logaddexp(b[:, :1] + trans[0], b[:, 1:] + trans[1])
    bwd = np.zeros_like(emit)
    for t in range(int(n[0]) - 2, -1, -1):
        at = s[: alive[t + 1]] + t
        nxt = emit[at + 1] + bwd[at + 1]
        bwd[at] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
    ends = s + n - 1
    z = np.logaddexp(fwd[ends, 0], fwd[ends, 1])
    whole = np.zeros(len(emit))
    whole[np.repeat(s, n) + np.concatenate([np.arange(k) for k in n])] = np.repeat(z, n)
    p = np.exp(fwd + bwd - whole[:, None])
    inner = np.ones(len(emit), bool)
    inner[s] = False
    at = np.flatnonzero(inner)
    if len(at):
        both = fwd[at - 1][:, :, None] + trans[None] + (emit[at] + bwd[at])[:, None, :] - whole[at][:, None, None]
        pairs = np.exp(both).sum(axis=0)
    return p, pairs, float(z.sum())


def fit_crf(x: np.ndarray, counts: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a line's features for label 1, and the 2 by 2 weights of neighbouring labels, by Adam on the
    conditional likelihood. ``label`` is each line's."""
    n = len(x)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(n, bool)
    inner[(np.cumsum(counts) - counts)[counts > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[at - 1], label[at]), 1)
    theta = np.zeros(len(w) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        emit = np.stack([np.zeros(n), x @ w], axis=1)
        p, pairs, _ = marginals(emit, trans, counts)
        g = np.append(x.T @ (p[:, 1] - label), (pairs - seen).ravel()) / max(1, n) + RIDGE * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, trans = theta[:-4], np.clip(theta[-4:].reshape(2, 2), -4, 4)
    return w, trans


def document_odds(p: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean of the good marginals; nan for texts without lines."""
    out = np.full(len(counts), np.nan)
    some = counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        mean = np.add.reduceat(p * sizes, starts) / np.add.reduceat(sizes, starts)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        out[some] = np.log(mean / (1 - mean))
    return out


def train(labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_lines: int = MAX_TRAIN_LINES) -> dict:
    """Learn from at most ``max_docs`` rows of ``(text, quality)``, and of them at most ``max_lines`` lines. Lines take their
    document's label. Spark makes the line statistics; the driver gets ``OWN`` numbers for each of the bounded lines.
    """
    rows = labelled.where("text is not null and quality is not null").select("text", F.col("quality").cast("int").alias("quality"))
    n_lines = F.size(F.split("text", "\n"))
    blank = labelled.where("quality is not null").where(F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")) == "")
    blank = blank.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("quality").cast("int")), F.lit(0)).alias("good")).first()
    empty = blank.good / (blank.n + 1)
    total = rows.agg(F.count("*").alias("n"), F.sum("quality").alias("good")).first()
    if not total.n or total.good in (0, total.n):
        return {"w": np.zeros(3 * OWN), "trans": np.zeros((2, 2)), "empty": empty, "slope": 0.0, "bias": math.log(((total.good or 0) + 0.5) / ((total.n or 0) - (total.good or 0) + 0.5))}
    rows = bounded_rows(rows.where(n_lines <= max_lines // 10), max_docs)
    lines = rows.agg(F.sum(n_lines)).first()[0] or 0
    if lines > max_lines:  # a tenth to spare, since documents differ in length
        rows = bounded_rows(rows, max(1, int(0.9 * min(max_docs, total.n) * max_lines / lines)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, 4 << 20):
            lines, counts = split_lines(batch.column("text").to_pylist())
            x, sizes = line_statistics(lines, counts)
            ends = np.cumsum(counts)
            data = [np.hstack([x[e - c : e], sizes[e - c : e, None]]).astype(np.float32).tobytes() for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), batch.column("quality")], names=["x", "quality"])

    got = sorted(((bytes(r.x), r.quality) for r in rows.mapInArrow(make, "x binary, quality int").collect()))
    parts = [np.frombuffer(b, np.float32).reshape(-1, OWN + 1) for b, _ in got]
    counts, doc_label = np.array([len(p) for p in parts]), np.array([q for _, q in got])
    all_x = np.vstack(parts).astype(float) if parts else np.zeros((0, OWN + 1))
    sizes, x = all_x[:, -1], with_neighbours(all_x[:, :-1], counts)
    w, trans = fit_crf(x, counts, np.repeat(doc_label, counts))
    p, _, _ = marginals(np.stack([np.zeros(len(x)), x @ w], axis=1), trans, counts)
    odds = document_odds(p[:, 1], sizes, counts)
    slope, bias = _calibrate(odds[counts > 0], doc_label[counts > 0])
    return {"w": w, "trans": trans, "empty": empty, "slope": slope, "bias": bias}


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic regression on one number, by Newton's steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r = p * (1 - p)
        h = np.array([[r @ (z * z) + 1e-3, r @ z], [r @ z, r.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(p - y) @ z + 1e-3 * a, (p - y).sum()]))
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return a, b


def quality_score(docs: DataFrame, trained: dict, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """One row per input row: the columns in ``keep``, ``score``, ``predicted``, ``n_lines``, ``n_bad_lines``.

    Null and blank texts have no lines: they get the share of label 1 among the labelled blank texts (one more bad one counted, so 0
    where none is labelled). Other columns, also of the same names, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, trans = trained["w"], trained["trans"]
        for batch in text_chunks(batches, 2 << 20, "_text"):
            lines, counts = split_lines([t or "" for t in batch.column("_text").to_pylist()])
            x, sizes = line_statistics(lines, counts)
            emit = np.stack([np.zeros(len(x)), with_neighbours(x, counts) @ w], axis=1)
            p, _, _ = marginals(emit, trans, counts)
            odds = document_odds(p[:, 1], sizes, counts)
            score = np.where(counts > 0, 1 / (1 + np.exp(-np.clip(trained["slope"] * np.nan_to_num(odds) + trained["bias"], -30, 30))), trained["empty"])
            bad = np.bincount(np.repeat(np.arange(len(counts)), counts), p[:, 1] < 0.5, len(counts))
            made = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array(counts), pa.array(bad.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "score", "predicted", "n_lines", "n_bad_lines"])

    kept = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "score double, predicted int, n_lines long, n_bad_lines long"])
    return docs.select(*keep, docs["text"].alias("_text")).mapInArrow(run, schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where("quality is not null").where(~held_out()).select("doc_id", "quality")
    # bounded before texts are looked up, so that none is shuffled
    taught = docs.where(~held_out()).select("doc_id", "text").join(F.broadcast(bounded_ids(labels, MAX_TRAIN_DOCS)), "doc_id")
    found = quality_score(docs, train(materialize(taught, "quality-taught")))  # written once, as several passes read it
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_lines", "n_bad_lines")
