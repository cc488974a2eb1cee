"""Removal of repeated byte strings by a blockwise suffix sort with a difference cover.

Which 100-byte strings start earlier in the corpus is read off suffixes sorted to that depth, one bucket at a time:

1. A suffix's bucket is its minimizer, the smallest of the k-gram hashes within its first 100 bytes. Equal strings have the same one
   at the same distance, and neighbouring suffixes mostly share it, so a stretch of neighbours travels as one piece of text.
   Only one share of the buckets is shuffled and sorted in each round, which bounds disk and memory.
2. In a bucket, equal stretches count once. The suffixes of the others are sorted by their first 8 bytes;
   long ties are resolved by ranks of the cover sample, computed before by doubling, and by the last bytes.
3. Of equal strings all but the earliest are marked; each document gets its marked bytes removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import materialize, read_table, row_key, text_chunks

LENGTH = 100
#: Bytes of the k-grams whose hashes pick the bucket.
GRAM = 24
#: Difference cover modulo 16: every difference of residues occurs, and gaps are at most 8.
COVER, PERIOD = (0, 1, 2, 5, 8), 16
#: Shares of the buckets, sorted one after the other, and text that one task sorts at once.
ROUNDS, TASK_BYTES, CHUNK_BYTES = 2, 32 << 20, 4 << 20
#: Buckets of a round, at least, so that a common passage's bucket does not share its task with much else.
LEAST_BUCKETS = 32
#: Tasks of a round, at most: beyond, a task sorts several buckets, one after the other.
MOST_TASKS = 20_000
#: Pieces that a task remembers beyond a chunk: those that a chunk had more than once.
HOT_PIECES = 50_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def stretches(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand one after the other (``ends``: where each stops), the maximal runs of suffixes with the same
    minimizer: each run's first suffix, how many, its minimizer's place and hash. Suffixes shorter than ``length`` have none."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    n = len(data)
    if n < length:
        return none
    up, down = _powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    h = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    del up, down, total
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    # smallest upper half of a hash, leftmost of equals: a rule that does not depend on what else is in the chunk
    place = np.uint64((1 << 32) - 1)
    low = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    window = length - gram + 1
    width = 1
    while width * 2 <= window:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = window - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    at = (low & place).astype(np.int64)  # where each suffix has its minimizer
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(n + 1, np.int8)
    long_enough = ends - starts >= length
    np.add.at(valid, starts[long_enough], 1)
    np.add.at(valid, ends[long_enough] - length + 1, -1)
    valid = np.cumsum(valid[: len(at)]) > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    begin = np.flatnonzero(first)
    if not len(begin):
        return none
    stops = np.flatnonzero(valid & ~np.append(valid[1:], False)) + 1
    nxt = np.append(begin[1:], len(at))
    stop = np.minimum(nxt, stops[np.searchsorted(stops, begin, side="right")])
    return begin, stop - begin, at[begin], h[at[begin]]


def _pairs_rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs, in order."""
    _, rank = np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)
    return rank.astype(np.int64)


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, so that their order is the bytes' order."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | data[at + k].astype(np.uint64)
    return out


def sort_suffixes(data: np.ndarray, at: np.ndarray, anchor: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Ranks of the ``length``-byte strings at ``at``, in the order of their bytes for equal anchors; equal strings get equal ranks.

    ``anchor`` is the place in the text from which residues count (a string's own minimizer), so equal strings
    meet the cover at the same distance. All ``length`` bytes from each place must be there.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    residue = (at - anchor) % PERIOD
    step = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
    delta = step[residue]  # at most 7: the cover sample that the suffix meets first
    # the sample: ranks of 16 bytes, then by doubling along the sample's own period 32, 64 and 80 bytes
    depth = (length - 8) // PERIOD * PERIOD if length < 88 else 80
    sample = at + delta
    links = [sample + k for k in range(0, depth, PERIOD)]
    every, where = np.unique(np.concatenate(links), return_inverse=True)
    _, r8 = np.unique(_word(data, every), return_inverse=True)
    _, r8b = np.unique(_word(data, every + 8), return_inverse=True)
    r16 = _pairs_rank(r8, r8b)
    where = where.reshape(len(links), len(at))
    ranks = [r16[w] for w in where]
    while len(ranks) > 1:
        ranks = [_pairs_rank(ranks[k], ranks[k + 1]) if k + 1 < len(ranks) else ranks[k] for k in range(0, len(ranks), 2)]
    # the string: first 8 bytes, then the sample's rank, then what reaches beyond the sample
    _, rank = np.unique(_word(data, at), return_inverse=True)
    _, rank_of_delta = np.unique(delta, return_inverse=True)
    rank = _pairs_rank(_pairs_rank(rank, rank_of_delta), ranks[0])
    tail = depth
    while tail < length:
        _, w = np.unique(_word(data, at + min(tail, length - 8)), return_inverse=True)
        rank = _pairs_rank(rank, w)
        tail += 8
    return rank


def marks_of_bucket(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, count: np.ndarray, anchor: np.ndarray, texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """``(piece, first, how many)`` of the suffixes that are not the earliest of their equals. A piece is a run of suffixes: minimizer
    hash ``h``, document order ``doc`` and ``pos`` of its first, their ``count``, the minimizer's distance ``anchor``, and its text."""
    order = np.lexsort((pos, doc, h))
    out: list[tuple[int, int, int]] = []
    hs = h[order]
    cuts = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
    sizes = np.diff(np.append(cuts, len(hs)))
    keep: list[int] = []
    for start, size in zip(cuts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        seen: dict[bytes, int] = {}
        own = []
        for k in order[start : start + size].tolist():
            if texts[k] in seen:  # an equal piece stands earlier: all its suffixes do, but for a repeated row's
                first = seen[texts[k]]
                if doc[first] != doc[k] or pos[first] != pos[k]:
                    out.append((k, 0, int(count[k])))
            else:
                seen[texts[k]] = k
                own.append(k)
        if len(own) > 1:
            keep += own
    if not keep:
        return out
    data = np.frombuffer(b"".join(texts[k] for k in keep) + bytes(PERIOD), np.uint8)
    kept = np.array(keep)
    n = count[kept]
    base = np.cumsum([0, *(len(texts[k]) for k in keep[:-1])])
    piece = np.repeat(np.arange(len(keep)), n)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at = base[piece] + offset
    rank = sort_suffixes(data, at, (base + anchor[kept])[piece], length)
    _, group = np.unique(h[kept], return_inverse=True)
    rank = _pairs_rank(group[piece], rank)
    by = np.lexsort((pos[kept][piece] + offset, doc[kept][piece], rank))
    later = np.zeros(len(at), bool)
    later[by[1:]] = rank[by[1:]] == rank[by[:-1]]
    # an equal at the very same document and place (repeated rows) does not count as earlier
    same = (doc[kept][piece][by[1:]] == doc[kept][piece][by[:-1]]) & ((pos[kept][piece] + offset)[by[1:]] == (pos[kept][piece] + offset)[by[:-1]])
    if same.any():
        for k in np.flatnonzero(same).tolist():
            later[by[k + 1]] = later[by[k]]
    edge = np.flatnonzero(later & np.append(True, (piece[1:] != piece[:-1]) | ~later[:-1]))
    stop = np.flatnonzero(later & np.append((piece[1:] != piece[:-1]) | ~later[1:], True))
    out += [(int(kept[piece[a]]), int(offset[a]), int(b - a + 1)) for a, b in zip(edge.tolist(), stop.tolist(), strict=True)]
    return out


_PIECES = "bucket int, doc_id long, key long, pos int, count int, anchor int, h long, text binary"


def repeated_starts(docs: DataFrame, total_bytes: int, length: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, key, starts)``: runs ``(first, how many)`` of byte places at which a string of ``length`` bytes starts that also starts
    earlier; one table of marks is written for each round of buckets."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", row_key().alias("key"), "text")
    buckets = max(LEAST_BUCKETS, -(-4 * total_bytes // (rounds * TASK_BYTES)))

    def cut(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot: dict[bytes, tuple] = {}  # the earliest place that this task has seen of a common piece
            for batch in text_chunks(batches, CHUNK_BYTES):
                ids = batch.column("doc_id").to_pylist()
                order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
                keys = batch.column("key").to_pylist()
                texts = [(batch.column("text")[k].as_py() or "").encode("utf-8") for k in order]
                ends = np.cumsum([len(t) for t in texts])
                whole = b"".join(texts)
                begin, count, at, h = stretches(np.frombuffer(whole, np.uint8), ends, length)
                mine = np.flatnonzero(h % np.uint64(rounds) == turn)
                begin, count, at, h = begin[mine], count[mine], at[mine], h[mine]
                doc = np.searchsorted(ends, begin, side="right")
                base = np.concatenate([[0], ends[:-1]])[doc]
                seen: dict[bytes, tuple] = {}
                cols: list[list] = [[] for _ in range(8)]
                spot = (h // np.uint64(rounds) % np.uint64(buckets)).astype(np.int64).tolist()
                signed = h.view(np.int64).tolist()
                for d, b, c, p, x, g, o in zip(doc.tolist(), begin.tolist(), count.tolist(), at.tolist(), spot, signed, base.tolist(), strict=True):
                    piece = whole[b : b + c + length - 1]
                    k = order[d]
                    own = (ids[k] is None, ids[k] or 0, b - o)
                    known = seen.setdefault(piece, own)
                    if known is not own and (piece in hot or len(hot) < HOT_PIECES):
                        hot[piece] = min(known, hot.get(piece, known))
                    # a piece that this task has had at an earlier place is marked at once: its text need not travel, and it may be
                    # dealt anywhere, so that a passage in many documents does not fill one bucket
                    repeated = min(known, hot.get(piece, known)) < own
                    spot_of = (p + 31 * b + (ids[k] or 0)) % buckets if repeated else x
                    for col, v in zip(cols, (spot_of, ids[k], keys[k], b - o, c, -1 if repeated else p - b, g, b"" if repeated else piece), strict=True):
                        col.append(v)
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["bucket", "doc_id", "key", "pos", "count", "anchor", "h", "text"])

        return run

    def sort(table: pa.Table) -> pa.Table:
        doc_id, key, pos, count, anchor = (table.column(c) for c in ("doc_id", "key", "pos", "count", "anchor"))
        anchors, starts = anchor.to_numpy(), pos.to_numpy()
        counts = count.to_numpy()
        asked = np.flatnonzero(anchors >= 0)
        order = doc_id.fill_null(np.iinfo(np.int64).max).to_numpy()
        text = table.column("text").take(asked).to_pylist() if len(asked) else []
        found = marks_of_bucket(table.column("h").to_numpy()[asked].view(np.uint64), order[asked], starts[asked].astype(np.int64), counts[asked], anchors[asked], text, length)
        known = np.flatnonzero(anchors < 0)
        which = np.concatenate([known, asked[[f[0] for f in found]] if found else np.zeros(0, np.int64)]).astype(np.int64)
        first = np.concatenate([starts[known], starts[asked[[f[0] for f in found]]] + np.array([f[1] for f in found]) if found else np.zeros(0, np.int64)])
        many = np.concatenate([counts[known], np.array([f[2] for f in found], np.int64) if found else np.zeros(0, np.int64)])
        return pa.table({"doc_id": doc_id.take(which), "key": key.take(which), "first": pa.array(first.astype(np.int32)), "many": pa.array(many.astype(np.int32))})

    parts = []
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    try:
        spark.conf.set(cleanup, "true")  # a round's shuffle files go when its marks are written
        for turn in range(rounds):
            pieces = rows.mapInArrow(cut(turn), _PIECES)
            # as many tasks as buckets, so that none grows with the input; buckets are sorted one at a time, whatever a task holds
            marks = pieces.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(sort, "doc_id long, key long, first int, many int")
            parts.append(materialize(marks, f"suffix-marks-{turn}"))
    finally:
        spark.conf.set(cleanup, before)
    marks = parts[0]
    for p in parts[1:]:
        marks = marks.unionByName(p)
    return marks.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "many")).alias("starts"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept`` (bytes).

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a document of smaller id, or earlier in its own.
    Rows with the same id count as one document: the same place in each is no repeat. Null ids come last and count as one.
    A null text counts as empty. ``doc_id`` must be an integer column: order of ids decides what stays.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer column")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    starts = repeated_starts(docs, total, length, rounds).withColumnsRenamed({"doc_id": "s_id", "key": "s_key"})
    keyed = docs.withColumn("key", row_key())
    joined = keyed.join(starts, (F.col("key") == F.col("s_key")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left").select("doc_id", "text", "starts")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, 16 << 20):
            cols: list[list] = [[] for _ in range(5)]
            for text, runs in zip(batch.column("text"), batch.column("starts"), strict=True):
                data = (text.as_py() or "").encode("utf-8")
                gone = np.zeros(len(data) + 1, np.int32)
                if runs.is_valid:
                    flat = runs.values
                    first, many = flat.field("first").to_numpy(), flat.field("many").to_numpy()
                    np.add.at(gone, first, 1)
                    np.add.at(gone, first + many - 1 + length, -1)
                gone = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
                spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(data) else 0
                for col, v in zip(cols, (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
