"""BPE encoding and decoding with forced boundaries.

A cut between two neighbouring byte symbols is *forced* where no token of the vocabulary holds that
pair side by side: no merge can ever reach across it. A word is cut at all its forced boundaries, the
fragments are encoded on their own, and their ids are concatenated; the result is what merging the
whole word gives. Fragments repeat far more often than words, so each worker keeps those it has seen.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .shared import CHUNK_BYTES, giving_back, text_chunks

#: Entries a worker keeps for pieces of text and for fragments; when full, it starts afresh, and after each task.
CACHE_ENTRIES = 400_000
#: Symbols of a fragment up to which the plain merge loop is faster than the heap.
SHORT = 48


def _byte_symbols() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ForcedBoundaryBPE:
    """One tokenizer file of the BPE kind with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern).findall
        #: outside these characters Unicode versions differ (and str.split() knows four separators more);
        #: such texts take the library's own normalizer and splitter
        self.unusual = regex.compile(r"[^\x00-\x1b\x20-\u052f\u2010-\u206f]").search
        self.library = Tokenizer.from_file(path)
        self.symbols = dict(enumerate(_byte_symbols()))
        self.token_of = {i: t for t, i in {**self.vocab, **self.special}.items()}
        #: pairs of neighbouring symbols inside some token; every other pair is a forced boundary
        self.inside: set[tuple[str, str]] = set()
        for token in self.vocab:
            parts = self._symbols_of_token(token)
            self.inside.update(zip(parts, parts[1:], strict=False))
        self.fragment_cache: dict[str, list[int]] = {}

        shown_id = {i: str(i) for i in self.token_of}
        self.token_of_shown = {shown: self.token_of[i] for i, shown in shown_id.items()}

        def ids_of_chunk(chunk: str) -> str:
            """The chunk's ids as text."""
            ids: list[int] = []
            for word in self._shown(chunk):
                ids += self.word_ids(word)
            return " ".join([shown_id[i] for i in ids])

        self.ids_of = _Remembered(ids_of_chunk)

    def _symbols_of_token(self, token: str) -> list[str]:
        if token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _merge(self, key: str, parts: list[str]) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left. ``key`` names the fragment."""
        found = self.fragment_cache.get(key)
        if found is not None:
            return found
        word = self._merge_short(parts) if len(parts) <= SHORT else self._merge_long(parts)
        ids = [self.vocab[t] for t in word if t in self.vocab]
        if len(self.fragment_cache) >= CACHE_ENTRIES:
            self.fragment_cache.clear()
        self.fragment_cache[key] = ids
        return ids

    def _merge_short(self, word: list[str]) -> list[str]:
        rank_of, never = self.ranks.get, len(self.ranks)
        ranks = [rank_of(pair, never) for pair in zip(word, word[1:], strict=False)]
        while ranks:
            rank = min(ranks)
            if rank == never:
                break
            at = ranks.index(rank)
            word[at] += word[at + 1]
            del word[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of((word[at], word[at + 1]), never)
            if at:
                ranks[at - 1] = rank_of((word[at - 1], word[at]), never)
        return word

    def _merge_long(self, word: list[str]) -> list[str]:
        """The same merges by a heap over linked places: n log n for a fragment of n symbols."""
        rank_of, n = self.ranks.get, len(word)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank, k) for k in range(n - 1) if (rank := rank_of((word[k], word[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            nxt = after[k]
            if nxt < 0 or word[k] is None or rank_of((word[k], word[nxt])) != rank:
                continue  # one of the two has been merged since
            word[k] += word[nxt]
            word[nxt] = None
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
                if (new := rank_of((word[k], word[after[k]]))) is not None:
                    heapq.heappush(heap, (new, k))
            if before[k] >= 0 and (new := rank_of((word[before[k]], word[k]))) is not None:
                heapq.heappush(heap, (new, before[k]))
        return [w for w in word if w is not None]

    def word_ids(self, shown: str) -> list[int]:
        """Ids of one pre-token in byte symbols: cut at the forced boundaries, encode each fragment, concatenate."""
        parts = [*shown]
        parts[-1] += self.end
        pairs = [*zip(parts, parts[1:], strict=False)]
        if self.inside.issuperset(pairs):
            return self._merge(shown + self.end, parts)
        ids: list[int] = []
        start, inside = 0, self.inside
        for k, pair in enumerate(pairs, 1):
            if pair not in inside:
                ids += self._merge(shown[start:k], parts[start:k])
                start = k
        return ids + self._merge(shown[start:] + self.end, parts[start:])

    def _shown(self, text: str) -> list[str]:
        """Pre-tokens of normalized text, in byte symbols."""
        if not self.unusual(text):
            return [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.symbols) for w in self.pieces(text)]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def normalize(self, text: str) -> str:
        """NFC, then each character's own lower case (no final-sigma rule)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str | None) -> tuple[str, str, int]:
        """``(ids, decoded, n)``: decimal ids joined by one space, the decoded text, and their number."""
        ids = []
        for part in self.split_special.split(text) if text and "<|" in text else (text or "",):
            if part in self.special:
                ids.append(str(self.special[part]))
            elif part:
                odd = self.unusual(part)
                part = self.library.normalizer.normalize_str(part) if odd else self.normalize(part)
                chunks = [c for c in part.split(" ") if c] if odd else part.split()
                if chunks:
                    ids.append(" ".join(map(self.ids_of.__getitem__, chunks)))
        joined = " ".join(ids)
        return joined, self.decode(joined), joined.count(" ") + 1 if joined else 0

    def decode(self, ids: str) -> str:
        """The text of ids joined by one space: their tokens, joined likewise."""
        return " ".join(map(self.token_of_shown.__getitem__, ids.split(" "))) if ids else ""


class _Remembered(dict):
    """What ``make`` gave for the keys seen of late."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[key] = self.make(key)
        return value


@functools.lru_cache(maxsize=4)
def load(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def bpe_encode_decode(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode every whole text, then decode the ids: one row per input row.

    A null text counts as empty: no ids, empty decoded text. Rows stay in their partitions (no
    shuffle). ``tokenizer_path`` must be readable on every executor, as an installed package's file is.
    Adds ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` to the columns in ``keep``, and with
    ``with_ids`` also ``ids`` and ``decoded``. Other columns, also of the same names, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in text_chunks(batches, CHUNK_BYTES, "_text"):
            n, ids_hash, decoded_hash, ids, decoded = [], [], [], [], []
            for value in batch.column("_text").to_pylist():
                joined, back, count = bpe.encode(value)
                n.append(count)
                ids_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded_hash.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    ids.append([int(x) for x in joined.split()])
                    decoded.append(back)
            made = [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())]
            if with_ids:
                made += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=names)
        for cache in (bpe.ids_of, bpe.fragment_cache):
            cache.clear()

    kept = docs.select(*keep)
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if with_ids else ())]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "n_tokens long, ids_sha256 string, decoded_sha256 string", *(["ids array<int>, decoded string"] if with_ids else [])])
    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(giving_back(run), schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .shared import read_table

    return bpe_encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
