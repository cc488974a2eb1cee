"""Toxicity with noisy-channel deobfuscation.

A disguised word ("1d10t", "i d i o t", "i.d.i.o.t", "idiooot") is a lattice: each sign may be itself, a letter that
it stands for, or nothing (a repetition or a separator). A Viterbi search through the lattice, under a
character trigram model of the whole corpus and a cost for each substitution, restores the word; the restored text is then scored by
the toxic words that labelled documents have taught.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CHUNK_BYTES, bounded_ids, bounded_rows, giving_back, materialize, read_table, text_chunks

#: The letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .-_*"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Classes of the character model: 0 is a word boundary, 1 to 26 the letters, 27 any other letter.
CLASSES = 28
SUBSTITUTE, REPEAT, SEPARATE = 1.0, 0.5, 0.0

#: Labelled documents that the word list is learned from, at most.
MAX_TRAIN_DOCS = 12_000
#: Words in the list, at most, how surely a word must be toxic (decimal digits of
#: chance) and how strongly (log ratio) to be listed.
MAX_WORDS, LEAST_EVIDENCE, LEAST_RATIO = 2_000, 7.0, 2.0
#: Ridge of the regression on the listed words; it leaves little to words that merely keep toxic ones company.
RIDGE, STEPS = 1e-5, 600
#: A toxic row counts as so many clean ones in the fit.
TOXIC_WEIGHT = 3.0
CACHE_ENTRIES = 200_000
#: Lengths of the stretches of spaced letters where no word list says which are wanted.
STRETCHES = range(3, 41)

_EDGE = ".,;:?\"'`´’“”()[]{}<>«»¿¡…–—"
_RUN_AT_END = re.compile(r"([!$*%&#@|+~^=_-])\1+$")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?:[\s.\-_*]+(?:[^\W_]|[@$!|+])){2,}(?![^\s.,;:!?])")
_BETWEEN = re.compile(r"[\s.\-_*]+")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_HAS_SIGN = re.compile("[" + re.escape("".join(SIGNS)) + r"._*\-]")


def char_class(c: str) -> int:
    return LETTERS.index(c) + 1 if c in LETTERS else 27


def _class_table() -> np.ndarray:
    table = np.zeros(0x3000, np.uint8)
    for code in range(0x3000):
        c = chr(code)
        if c.isalpha():
            table[code] = char_class(c.lower()) if c.lower() in LETTERS else 27
    return table


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(trigram, n)`` over all letters of all documents, as ``(a*28+b)*28+c`` of the classes; at most 28^3 rows,
    combined in each partition before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _class_table(), np.zeros(CLASSES**3, np.int64)
        for batch in text_chunks(batches, CHUNK_BYTES, "_text"):
            joined = "\n\n".join(t for t in batch.column("_text").to_pylist() if t)
            codes = np.frombuffer(("\n\n" + joined + "\n\n").encode("utf-32-le", "replace"), np.uint32)
            classes = table[np.minimum(codes, 0x2FFF)].astype(np.int32)
            classes[codes >= 0x3000] = 27
            total += np.bincount((classes[:-2] * CLASSES + classes[1:-1]) * CLASSES + classes[2:], minlength=CLASSES**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["trigram", "n"])

    return docs.select(F.col(text).alias("_text")).mapInArrow(giving_back(count), "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


def _spelled(path: tuple | None) -> str:
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters)).strip()


class CharacterModel:
    """Costs (negative log probabilities) of a letter after two others, with add-one smoothing."""

    def __init__(self, counts: dict[int, int]) -> None:
        n = np.zeros(CLASSES**3)
        for k, v in counts.items():
            n[k] = v
        n = n.reshape(CLASSES, CLASSES, CLASSES) + 0.5
        self.cost = -np.log(n / n.sum(axis=2, keepdims=True))
        self.rows = self.cost.tolist()

    def restore(self, shown: str, cut: bool = False) -> tuple[str, float]:
        """The best path through the lattice of ``shown``, and its cost a letter. With ``cut`` each separator may also end a word,
        and the words found have a space between them. Time and memory are linear in the length: paths share their beginnings."""
        # states: (last two classes, last letter) -> (cost, path), a path being (path before, letter)
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for c in shown:
            after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            options = [(x, SUBSTITUTE) for x in SIGNS.get(c, "")]
            if c.isalpha():
                options.append((c, 0.0))
            drop = SEPARATE if c in SEPARATORS else REPEAT * 4 if c in SIGNS and not c.isalpha() else None
            ends = cut and c in SEPARATORS
            for (a, b, last), (cost, path) in states.items():
                for letter, extra in options:
                    k = char_class(letter)
                    key, new = (b, k, letter), cost + extra + self.rows[a][b][k]
                    if key not in after or new < after[key][0]:
                        after[key] = (new, (path, letter))
                if ends and b:
                    key, new = (b, 0, ""), cost + self.rows[a][b][0]
                    if key not in after or new < after[key][0]:
                        after[key] = (new, (path, " "))
                gone = REPEAT if c == last and c.isalpha() else drop
                if gone is None and any(x == last for x, _ in options) and last:
                    gone = REPEAT + SUBSTITUTE
                if gone is not None:
                    key = (a, b, last)
                    if key not in after or cost + gone < after[key][0]:
                        after[key] = (cost + gone, path)
            states = after or states
        ends_at = [(cost + self.rows[a][b][0], path) for (a, b, _), (cost, path) in states.items()]
        least = min(cost for cost, _ in ends_at)
        word = min(_spelled(path) for cost, path in ends_at if cost == least)
        return word, least / max(1, len(word))

    def candidates(self, shown: str) -> list[str]:
        """The restored word; with letters tripled or more also each such run cut to one and to two."""
        out = [self.restore(shown)[0]]
        if _LONG_RUN.search(shown):
            out += [self.restore(re.sub(r"([^\W\d_])\1\1+", r"\1", shown))[0], self.restore(re.sub(r"([^\W\d_])\1\1+", r"\1\1", shown))[0]]
        return out


class Deobfuscator:
    """Restores the disguised words of a text; keeps the tokens seen of late. ``lengths``: of the stretches of a run of single
    letters that are read as words, wherever they start; all words of these lengths are found."""

    def __init__(self, model: CharacterModel, lengths: Iterable[int] = STRETCHES) -> None:
        self.model = model
        self.lengths = sorted({*lengths})
        self.seen: dict[str, tuple[str, ...]] = {}

    def _token(self, token: str) -> tuple[str, ...]:
        core = _RUN_AT_END.sub("", token.strip(_EDGE)).strip(_EDGE)
        if core.isalpha():
            return (core, *self.model.candidates(core)) if _LONG_RUN.search(core) else (core,)
        core = core.rstrip("!|+*-_.") if not any(ch.isalpha() for ch in core[-2:]) or core[-1:] in "!*-_." else core
        letters = sum(ch.isalpha() for ch in core)
        if core.isalpha():
            return (core,)
        if letters >= 1 and _HAS_SIGN.search(core):
            parts = [p for p in re.split(r"[^\w@$!|+(€£]+", core) if p]
            inner = [p for p in parts if len(p) > 1]
            words = self.model.restore(core, cut=True)[0].split() if any(ch in SEPARATORS for ch in core) else ()
            return (*words, *(p for p in inner if p.isalpha()), *self.model.candidates(core), *(x for p in inner if not p.isalpha() and any(map(str.isalpha, p)) and p != core for x in self.model.candidates(p)))
        return tuple(p for p in re.split(r"[\W\d_]+", core) if p)

    def words(self, text: str) -> set[str]:
        """The words of the restored text."""
        low, seen, out = text.lower(), self.seen, set()
        for token in set(low.split()):
            found = seen.get(token)
            if found is None:
                if len(seen) >= CACHE_ENTRIES:
                    seen.clear()
                found = seen[token] = self._token(token)
            out.update(found)
        for m in _SPACED.finditer(low):
            out.update(self._spaced(m.group()))
        return out

    def _spaced(self, run: str) -> set[str]:
        """The words of a run of single letters: the whole run as one, the words of the best way to cut it, and,
        where it has letters and not signs alone, every stretch of the wanted lengths. Stretches come from both restored texts and from
        the signs as they stand, each taken for its first and for its last letter."""
        shown = _BETWEEN.sub("", run)
        run = " ".join(shown)
        words = self.model.restore(run, cut=True)[0].split()
        whole = self.model.restore(run)[0]
        out = {whole, *words}
        if any(ch.isalpha() for ch in run):
            for letters in {whole, "".join(words), *("".join(SIGNS.get(ch, ch)[k] for ch in shown) for k in (0, -1))}:
                out.update(letters[a : a + n] for n in self.lengths for a in range(len(letters) - n + 1))
        return out

    def restore_text(self, text: str) -> str:
        """The whole restored text (white space becomes one space)."""
        low = _SPACED.sub(lambda m: self.model.restore(" ".join(_BETWEEN.sub("", m.group())))[0], text.lower())
        return " ".join((self._token(t) or ("",))[-1] for t in low.split())


def train(docs: DataFrame, labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> dict:
    """Learn from ``labelled`` (``text``, ``toxic``; nulls are left out): the character model from all of
    ``docs``, the words from at most ``max_docs`` labelled rows (``bounded_rows``). What reaches the driver is bounded: 28^3 counts and ``MAX_WORDS`` words.
    """
    model = CharacterModel({r.trigram: r.n for r in trigram_counts(docs).collect()})
    rows = labelled.where("text is not null and toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = bounded_rows(rows, max_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Deobfuscator(model, ())  # stretches are only possible readings, no words to learn from
        toxic, clean = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            words = [*toxic.keys() | clean.keys()]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], names=["word", "toxic", "clean"])
            toxic.clear()
            clean.clear()
            return out

        for batch in text_chunks(batches, CHUNK_BYTES):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = toxic if label else clean
                own.update(reader.words(text))
                own["\0"] += 1  # stands for the documents themselves
                if len(toxic) + len(clean) > 200_000:
                    yield counted()
        yield counted()

    counts = materialize(rows.mapInArrow(giving_back(count), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-words")
    whole = counts.where(F.col("word") == "\0").first()
    n_toxic, n_clean = (whole.toxic, whole.clean) if whole else (0, 0)
    prior = math.log((n_toxic + 0.5) / (n_clean + 0.5))
    listed: list[str] = []
    if n_toxic and n_clean:
        share = n_toxic / (n_toxic + n_clean)
        n = F.col("toxic") + F.col("clean")
        p = F.least(F.greatest(F.col("toxic") / n, F.lit(1e-9)), F.lit(1 - 1e-9))
        # n times the divergence of the word's toxic share from the prior one bounds the chance of such a share
        digits = n * (p * F.log(p / share) + (1 - p) * F.log((1 - p) / (1 - share))) / math.log(10)
        weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1)))
        strong = counts.where((F.col("word") != "\0") & (p > share) & (digits >= LEAST_EVIDENCE)).select("word", weight.alias("weight"), digits.alias("digits"))
        listed = sorted(r.word for r in strong.where(F.col("weight") >= LEAST_RATIO).orderBy(F.desc("digits"), "word").limit(MAX_WORDS).collect())
    if not listed:
        return {"model": model, "words": {}, "prior": prior}
    place = {w: k for k, w in enumerate(listed)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Deobfuscator(model, map(len, listed))
        for batch in text_chunks(batches, CHUNK_BYTES):
            found = [[place[w] for w in place.keys() & reader.words(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("toxic")], names=["hits", "toxic"])

    # equal rows count together, so what is collected is small; at most max_docs rows of at most MAX_WORDS places
    taught = rows.mapInArrow(giving_back(hits), "hits array<int>, toxic int").groupBy(F.array_sort("hits").alias("hits"), "toxic").agg(F.count("*").alias("n")).collect()
    taught.sort(key=lambda r: (r.hits, r.toxic))
    x = np.zeros((len(taught), len(listed)), np.float32)
    for k, r in enumerate(taught):
        x[k, r.hits] = 1
    weights, prior = _fit(x, np.array([float(bool(r.toxic)) for r in taught]), np.array([r.n for r in taught], float))
    return {"model": model, "words": dict(zip(listed, weights.tolist(), strict=True)), "prior": prior}


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Adam on all rows; ``n`` are the rows' counts."""
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    w[-1] = math.log((y @ n + 0.5) / ((1 - y) @ n + 0.5))
    n = n * np.where(y > 0, TOXIC_WEIGHT, 1.0)
    share = n / n.sum()
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        miss = (p - y) * share
        g = np.append(x.T @ miss + RIDGE * w[:-1], miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w[:-1], float(w[-1])


def toxicity_score(docs: DataFrame, trained: dict, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """One row per input row: the columns in ``keep``, ``score`` and ``predicted``.

    The log odds start at the labelled share and gain each distinct toxic word of the restored text.
    Null and empty texts get the prior. Other columns, also of the same names, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, prior = trained["words"], trained["prior"]
        reader = Deobfuscator(trained["model"], map(len, weights))
        listed = weights.keys()
        for batch in text_chunks(batches, CHUNK_BYTES, "_text"):
            scores = []
            for text in batch.column("_text").to_pylist():
                odds = prior + sum(weights[w] for w in listed & reader.words(text)) if text else prior
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[*keep, "score", "predicted"])

    kept = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "score double, predicted int"])
    return docs.select(*keep, docs["text"].alias("_text")).mapInArrow(giving_back(run), schema)


def learn_from_tables(spark, docs: DataFrame, sf_dir: str) -> dict:
    """Train on the labelled documents outside the held-out third."""
    labels = read_table(spark, sf_dir, "labels").where("toxic is not null").where(~held_out()).select("doc_id", "toxic")
    # bounded before texts are looked up, so that none is shuffled; written once, as three passes read it
    taught = docs.where(~held_out()).select("doc_id", "text").join(F.broadcast(bounded_ids(labels, MAX_TRAIN_DOCS)), "doc_id")
    return train(docs, materialize(taught, "toxic-taught"))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity_score(docs, learn_from_tables(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
