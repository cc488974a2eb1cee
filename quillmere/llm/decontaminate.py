"""Benchmark decontamination: CGK walks, bit-sampling LSH, exact edit distances.

1. Texts are strings of words. The random walk of Chakraborty, Goldenberg and Koucky (2016) maps windows to strings in which few
   edits become few differing coordinates; keys of a few sampled coordinates, repeated over many walks, then meet (LSH).
2. The distortion of a walk grows with the square of the edits, so an item of more than about ``PIECE`` words is embedded in pieces of that
   size: of m pieces one has at most 1/m of the edits, whatever their kind and place, and it is this piece whose keys meet. Without that,
   recall falls with an item's length (measured before: 0.5 at 100 words with a fifth left out).
3. Only windows around places that can hold a match are embedded: an edit spoils at most q grams of q neighbouring words, so a match
   leaves a known number of grams of the benchmark close together. This filter loses nothing.
4. Items whose keys meet are verified by the exact edit distance on the stretch around the window.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CHUNK_BYTES, giving_back, materialize, read_table, text_chunks

#: Edits allowed, as a share of an item's words (rounded down).
MAX_EDIT = 0.2
#: Benchmark text that one pass over the documents compares with, at most; a larger benchmark takes several passes. The tables of a pass
#: travel with its tasks and take up to some 46 times its text.
PASS_BYTES = 1 << 20
CACHE_ENTRIES = 300_000
#: Words of a piece, about; walks, keys of each walk, and coordinates of a key. At one edit in a piece of 8 words a key meets with a chance
#: of 0.2 or more, so that 96 keys all miss with a chance below 1e-6; tests hold the recall by length and kind of edit.
PIECE, WALKS, KEYS, SAMPLED = 8, 16, 6, 3
#: Windows that are embedded together.
WINDOWS = 4_000
_EDGES = ".,;:!?\"'`()[]{}<>*#$%&|-–—…«»“”‘’¿¡_=+~^/\\"


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without signs at their ends; words of signs alone are left out."""
    return [w for w in (x.strip(_EDGES) for x in (text or "").lower().split()) if w]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    h = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def embed(words: np.ndarray, starts: np.ndarray, length: int, walk: int) -> np.ndarray:
    """CGK embeddings (rows: ``2 * length`` steps; columns: starts) of the windows of ``length`` words; 0 beyond a window's end. At each step the
    word at hand is written down, and a hash of it and of the step tells whether the walk goes on to the next word."""
    at, stop = starts.copy(), starts + length
    out = np.zeros((2 * length, len(starts)), np.uint64)
    for t in range(2 * length):
        inside = at < stop
        w = np.where(inside, words[np.minimum(at, len(words) - 1)], 0)
        out[t] = w
        at += (_mix(w, 0x51ED270B * (t + 1) + 0x9E3779B1 * walk) >> np.uint64(63)).astype(np.int64) & inside
    return out


@functools.lru_cache(maxsize=4096)
def _sampled(length: int, walk: int) -> np.ndarray:
    """The coordinates of each of the walk's keys."""
    rng = np.random.default_rng([length, walk])
    return np.array([np.sort(rng.choice(2 * length, min(SAMPLED, 2 * length), replace=False)) for _ in range(KEYS)])


def walk_keys(words: np.ndarray, starts: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """For each walk its keys (rows) of the windows (columns): hashes of the sampled coordinates."""
    for walk in range(WALKS):
        embedded = embed(words, starts, length, walk)
        h = ((length << 32) + (walk << 16) + np.arange(KEYS, dtype=np.uint64))[:, None]
        for c in _sampled(length, walk).T:
            h = _mix(h ^ embedded[c], 0xC2B2AE3D)
        yield h


def pieces_of(length: int) -> list[tuple[int, int]]:
    """``(first word, words)`` of the pieces that an item of ``length`` words is cut into."""
    many = max(1, round(length / PIECE))
    edges = [length * k // many for k in range(many + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


class PieceTable:
    """The keys of all pieces of one size of items of one length: sorted, with a bitmap that turns most windows away."""

    def __init__(self, size: int, words: np.ndarray, starts: np.ndarray, item: np.ndarray, offset: np.ndarray) -> None:
        self.size = size
        held = np.concatenate([h.ravel() for h in walk_keys(words, starts, size)])
        times = WALKS * KEYS
        order = np.argsort(held, kind="stable")
        self.held, self.item, self.offset = held[order], np.tile(item, times)[order], np.tile(offset, times)[order]
        self.some = np.zeros(1 << 16, bool)
        self.some[held >> np.uint64(48)] = True

    def meet(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and the places where each would start, for the windows whose keys meet a piece's."""
        items, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(starts), WINDOWS):
            own = starts[k : k + WINDOWS]
            for h in walk_keys(words, own, self.size):
                r, x = np.nonzero(self.some[h >> np.uint64(48)])
                low = np.searchsorted(self.held, h[r, x])
                many = np.searchsorted(self.held, h[r, x], side="right") - low
                at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                items.append(self.item[at])
                places.append(own[np.repeat(x, many)] - self.offset[at])
        both = np.unique(np.stack([np.concatenate(items), np.concatenate(places)]), axis=1)
        return both[0], both[1]


def best_match(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """Fewest edits between ``item`` and any stretch of ``text``, and where that stretch starts; None beyond ``most``."""
    row = [(0, k) for k in range(len(text) + 1)]
    for i, w in enumerate(item, 1):
        new = [(i, 0)]
        for k, x in enumerate(text, 1):
            d, s = row[k - 1]
            best = (d + (w != x), s)
            d, s = row[k]
            if d + 1 < best[0]:
                best = (d + 1, s)
            d, s = new[k - 1]
            if d + 1 < best[0]:
                best = (d + 1, s)
            new.append(best)
        row = new
        if min(row)[0] > most:
            return None
    edits, start = min(row)
    return (edits, start) if edits <= most else None


def _dense(places: np.ndarray, many: int, span: int) -> np.ndarray:
    """The places that are among ``many`` of which the first and last are at most ``span`` apart."""
    n = len(places) - many + 1
    if n <= 0:
        return places[:0]
    near = np.flatnonzero(places[many - 1 :] - places[:n] <= span)
    cover = np.zeros(len(places) + 1, np.int64)
    cover[near] += 1
    cover[near + many] -= 1
    return places[np.cumsum(cover[:-1]) > 0]


def _around(places: np.ndarray, span: int, least: int, end: int) -> np.ndarray:
    """All places at most ``span`` from one of ``places``, in order."""
    if not len(places):
        return places
    first = np.append(True, places[1:] - places[:-1] > 2 * span + 1)
    low, high = np.maximum(places[first] - span, least), np.minimum(places[np.append(first[1:], True)] + span, end - 1)
    many = np.maximum(0, high - low + 1)
    return np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


class _Codes(dict):
    """Numbers of the tokens seen of late; 0 for tokens of signs alone."""

    def __init__(self, finder: Finder) -> None:
        self.finder = finder

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        w = token.strip(_EDGES)
        value = self[token] = self.finder.code(w) if w else 0
        return value


class Finder:
    """The tables of one bounded slice of the benchmark."""

    def __init__(self, items: list[tuple[int, list[str]]], max_edit: float = MAX_EDIT) -> None:
        self.vocabulary = frozenset(w for _, ws in items for w in ws)
        self.items = [(i, [self.code(w) for w in ws]) for i, ws in items if ws]
        self.edits = [int(max_edit * len(ws)) for _, ws in self.items]
        self.longest = max((len(ws) for _, ws in self.items), default=0)
        by_length = defaultdict(list)
        for k, (_, ws) in enumerate(self.items):
            by_length[len(ws)].append(k)
        #: for each length of items: edits, size of grams, grams that survive the most edits, a piece's share of them, the tables of
        #: their pieces, each item's grams
        self.tables = []
        #: by size of grams: by the hash of a gram, bits of the lengths of the items that hold it; other grams may
        #: share a hash and other lengths a bit, none is missed
        self.marks: dict[int, np.ndarray] = {}
        for length, which in sorted(by_length.items()):
            edits = int(max_edit * length)
            # an edit spoils at most q grams of q words
            q = next((q for q in (3, 2) if length - q + 1 - q * edits > 0), 1)
            own_grams = {k: self._grams(np.array(self.items[k][1], np.uint64), q) for k in which}
            held = np.concatenate([own_grams[k] for k in which])
            self.marks.setdefault(q, np.zeros(1 << 20, np.uint64))[held >> np.uint64(44)] |= np.uint64(1 << length % 64)
            words = np.array([w for k in which for w in self.items[k][1]], np.uint64)
            cut = pieces_of(length)
            tables = []
            for size in sorted({n for _, n in cut}):
                offset = np.tile([a for a, n in cut if n == size], len(which))
                row = np.repeat(np.arange(len(which)), len(offset) // len(which))
                tables.append(PieceTable(size, words, row * length + offset, np.array(which)[row], offset))
            self.tables.append((length, edits, q, max(1, length - q + 1 - q * edits), edits // len(cut), tables, own_grams))
        self.codes = _Codes(self)

    def code(self, word: str) -> int:
        """A word's number: its hash, odd where the benchmark knows the word, never 0."""
        return (xxhash.xxh64_intdigest(word) | 3) - (word not in self.vocabulary)

    @staticmethod
    def _grams(words: np.ndarray, size: int) -> np.ndarray:
        """The hash of the ``size`` neighbouring words that start at each word, where there are so many."""
        h = words[: max(0, len(words) - size + 1)]
        for k in range(1, size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text its ``(place of the item, edits, first word)``, each item once, where it fits best."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not self.items:
            return out
        gap = np.zeros(2 * self.longest + 1, np.uint64)
        parts, firsts, at = [], [], 0
        code = self.codes.__getitem__
        for t in texts:
            tokens = t.lower().split() if t else []
            w = np.fromiter(map(code, tokens), np.uint64, len(tokens))
            w = w[w != 0]
            firsts.append(at)
            parts += [w, gap]  # no window reaches from one text into the next
            at += len(w) + len(gap)
        words = np.concatenate(parts)
        known = np.concatenate([[0], np.cumsum((words & np.uint64(1)).astype(np.int32))])
        grams = {q: self._grams(words, q) for q in self.marks}
        marked = {}
        for q, marks in self.marks.items():
            bits = marks[grams[q] >> np.uint64(44)]
            places = np.flatnonzero(bits)
            marked[q] = (places, bits[places])
        first, last = np.array(firsts), np.array([*firsts[1:], at]) - len(gap)
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for length, edits, q, whole, share, tables, own_grams in self.tables:
            places, bits = marked[q]
            own = places[(bits >> np.uint64(length % 64)) & np.uint64(1) > 0]
            span = length + edits - q  # a stretch within reach of an item starts its first and last gram so far apart at most
            starts = _around(_dense(own, whole, span), span + q, 0, len(words) - self.longest)
            starts = starts[words[starts] != 0]
            met = []
            for table in tables:
                # the piece with no more than its share of the edits leaves so many words of the benchmark in its window
                near = starts[known[starts + table.size] - known[starts] >= table.size - share]
                item, place = table.meet(words, near)
                doc = np.searchsorted(first, np.minimum(np.maximum(place, 0), at), side="right") - 1 if len(item) else item
                met += zip(item.tolist(), doc.tolist(), place.tolist(), strict=True)
            met.sort()
            k = 0
            while k < len(met):
                item, doc, place = met[k]
                begin, end = place - edits, place + length + edits
                k += 1
                while k < len(met) and met[k][:2] == (item, doc) and met[k][2] - edits <= end:  # stretches that overlap are one
                    end = met[k][2] + length + edits
                    k += 1
                for d in {doc, min(doc + 1, len(texts) - 1)}:  # a piece put before the text's first word belongs to the next text
                    low, high = max(begin, int(first[d])), min(end, int(last[d]))
                    if np.isin(grams[q][low : max(low, high - q + 1)], own_grams[item]).sum() < whole:
                        continue  # too few of its grams are left for so few edits
                    found = best_match(self.items[item][1], words[low:high].tolist(), edits)
                    if found and ((item, d) not in best or found[0] < best[item, d][1]):
                        best[item, d] = (item, found[0], low + found[1] - firsts[d], d)
        for k, edits, start, doc in best.values():
            out[doc].append((k, edits, start))
        return [sorted(x) for x in out]


def slices(benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> Iterator[Finder]:
    """The benchmark (``item_id``, ``text``) in slices of bounded size, made one at a time. Null ids or texts are left out; the size is asked of Spark
    first, so what is collected at once is bounded for any benchmark (but for a single longer item)."""
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(2 * total / pass_bytes)) if total > pass_bytes else 1
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        items = sorted({(r.item_id, r.text) for r in part.collect()})
        yield Finder([(i, words_of(t)) for i, t in items])


def searched(finder: Finder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int, int]]]]]:
    """The batches in slices of bounded size, each with what its texts hold."""
    for batch in text_chunks(batches, CHUNK_BYTES):
        yield batch, finder.search(batch.column("text").to_pylist())


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``(doc_id, item_id, edits, item_words, first_word)``: each item that a text holds within ``MAX_EDIT`` of its words, once a text.

    Null and empty texts hold nothing; repeated rows are reported each; rows with a null id under a null. No shuffle. The matches of a
    pass are written before the next, so that one pass's tables are held at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out, waiting = None, None
    for finder in slices(benchmark, pass_bytes):
        if waiting is not None:
            waiting = materialize(waiting, "benchmark-matches")
            out = waiting if out is None else out.unionByName(waiting)

        def run(batches: Iterator[pa.RecordBatch], finder: Finder = finder) -> Iterator[pa.RecordBatch]:
            for batch, found in searched(finder, batches):
                rows = [(d, *m) for d, of in zip(batch.column("doc_id").to_pylist(), found, strict=True) for m in of]
                cols = [
                    pa.array([r[0] for r in rows], batch.schema.field("doc_id").type),
                    pa.array([finder.items[r[1]][0] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([len(finder.items[r[1]][1]) for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "edits", "item_words", "first_word"])

        waiting = docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind}, item_id long, edits int, item_words int, first_word int")
    return waiting if out is None else out.unionByName(waiting)


def decontaminate(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns as they were. No shuffle. What a pass leaves is written before the next."""
    first = True
    for finder in slices(benchmark, pass_bytes):
        docs, first = docs if first else materialize(docs, "benchmark-free"), False

        def run(batches: Iterator[pa.RecordBatch], finder: Finder = finder) -> Iterator[pa.RecordBatch]:
            for batch, found in searched(finder, batches):
                yield batch.filter(pa.array([not m for m in found]))

        docs = docs.mapInArrow(giving_back(run), docs.schema)
    return docs


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
