"""N-gram Jaccard join by MinHash banding.

1. Every text becomes its set of hashed word n-grams and a MinHash signature cut into bands. Texts with equal
   sets are one class.
2. Band hashes are shuffled; the classes that share one are a bucket. Buckets with the very same members count once.
3. The texts of a bucket meet, a large bucket's dealt into blocks of bounded size, of which each pair is a tile. There each pair whose first
   common band this is gets verified on its full n-gram sets. A tile gives each class's links and a spanning forest of them, never the
   pairs; only verified links are then chained into groups, so that chance candidates never grow into one large component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embedding_dups import forest
from .shared import CHUNK_BYTES, connected_components, discard, give_back, giving_back, materialize, read_table, row_key, text_chunks

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Most hash functions of a signature.
MAX_HASHES = 128
#: A block of a bucket has about so many texts and n-grams at most (a longer text makes one of its own).
BLOCK_TEXTS, BLOCK_NGRAMS = 1024, 1_000_000
#: Words whose hashes a worker keeps; when full, it starts afresh, and after each task or tile.
CACHE_ENTRIES = 400_000


def choose_bands(threshold: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """``(bands, rows)``: as many rows a band as ``most`` hashes allow, with ``1 - (1 - threshold^rows)^bands >= recall``."""
    best = (most, 1)
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= most:
            best = (bands, rows)
    return best


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def forget_words() -> None:
    """Empty the worker's own cache; a task's function that named it would travel with a copy."""
    _hashes.clear()


def ngram_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of the text's lower-cased words. A text of fewer words is one
    n-gram of them all; a text without words has none."""
    parts = text.lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, len(w) if size < words else words, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(ngrams: np.ndarray, seeds: np.ndarray, bands: int) -> np.ndarray:
    """Band hashes of a set: each seed permutes 32-bit values, its smallest is one row."""
    x = (ngrams >> np.uint64(32)).astype(np.uint32) ^ ngrams.astype(np.uint32)
    low = np.full(seeds.shape[1], 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(low, ((x[k : k + 4096, None] ^ seeds[0]) * seeds[1]).min(axis=0), out=low)
    rows = low.reshape(bands, -1).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(rows.shape[1]):
        h = (h ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def seeds_for(n: int, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)])


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``key``, ``n`` (n-grams), ``set_id`` (16 bytes: equal sets), ``bands`` (8 bytes a band); no shuffle."""
    seeds = seeds_for(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, CHUNK_BYTES):
            n, ids, hashes = [], [], []
            for text in batch.column("text").to_pylist():
                s = ngram_set(text, words)
                n.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                hashes.append(signature(s, seeds, bands).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(hashes, pa.binary())], names=["doc_id", "key", "n", "set_id", "bands"])
        forget_words()

    return docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(giving_back(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n long, set_id binary, bands binary")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two sets share, for all pairs at once. N-grams in few sets add to their pairs one by one, those in many
    by a matrix product over slices of the n-grams."""
    n = len(sets)
    every, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(inverse, kind="stable")
    doc, starts = doc[order], np.cumsum(df) - df
    shared = np.zeros(n * n, np.float64)
    few = 24
    for d in range(2, few + 1):
        members = doc[starts[df == d][:, None] + np.arange(d)[None]]
        for a in range(d):
            for b in range(a + 1, d):
                shared += np.bincount(members[:, a].astype(np.int64) * n + members[:, b], minlength=n * n) if len(members) > n * n // 8 else 0
                if len(members) <= n * n // 8:
                    np.add.at(shared, members[:, a].astype(np.int64) * n + members[:, b], 1)
    shared = shared.reshape(n, n).astype(np.float32)
    many = np.flatnonzero(df > few)
    for k in range(0, len(many), 4096):
        part = many[k : k + 4096]
        x = np.zeros((n, len(part)), np.float32)
        for c, at in enumerate(part.tolist()):
            x[doc[starts[at] : starts[at] + df[at]], c] = 1
        shared += np.triu(x @ x.T, 1)
    return shared


def verified_pairs(sets: list[np.ndarray], bands: np.ndarray, left: np.ndarray, threshold: float, cross: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places ``a < b`` that share the last band but none before it, and whose sets have Jaccard similarity at or above
    ``threshold``. Where ``left`` tells places apart (a tile of two blocks), only pairs across are wanted; ``cross`` says so also where
    one block is empty."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    cross = not left.all() if cross is None else cross
    a, b = np.triu_indices(n, 1)
    wanted = (bands[a, -1] == bands[b, -1]) & (np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]))
    if cross:
        wanted &= left[a] != left[b]
    a, b = a[wanted], b[wanted]
    for k in range(bands.shape[1] - 1):
        new = bands[a, k] != bands[b, k]
        a, b = a[new], b[new]
    if len(a) <= 8 * n:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.float64)
    else:
        both = _overlaps(sets)[a, b].astype(np.float64)
    alike = both / (sizes[a] + sizes[b] - both) >= threshold
    return a[alike], b[alike]


def ngram_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block_texts: int = BLOCK_TEXTS, block_ngrams: int = BLOCK_NGRAMS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``key``, ``class_id``, ``n_links``, ``copies``, ``kept``.

    ``class_id`` is the smallest id among the documents that links reach; ``n_links`` counts the other rows
    linked directly, equal texts among them; ``copies`` the rows with the same n-gram set. ``kept`` marks the one
    document of the group that stays. A text without words (null, empty) links with nothing and is kept.
    Null ids take part; a group of null ids alone has a null ``class_id``. Repeated rows are copies of each other.
    """
    bands, rows = choose_bands(threshold, recall)
    sigs = materialize(signatures(docs, words, bands, rows), "ngram-signatures")
    some = sigs.where("n > 0")
    rep = F.min(F.struct("doc_id", "key")).alias("rep")
    classes = some.groupBy("set_id").agg(rep, F.count("*").alias("copies"), F.min("doc_id").alias("low_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "ngram-classes")

    hashes = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.substring("bands", k * 8 + 1, F.lit(8)))
    banded = classes.select("cid", "n", F.posexplode(hashes).alias("band", "h"))
    members = [F.count("*").alias("texts"), F.bit_xor(F.xxhash64("cid")).alias("mark"), F.bit_xor(F.xxhash64("cid", F.lit(7))).alias("mark_2")]
    buckets = banded.groupBy("band", "h").agg(*members, F.sum("n").alias("load"), F.min("cid").alias("low")).where("texts > 1")
    # of buckets with the same members the first band's is enough: a pair's first common band is never dropped
    buckets = buckets.groupBy("texts", "mark", "mark_2").agg(F.min(F.struct("band", "h", "load", "low")).alias("b")).select("texts", "b.*")
    blocks = F.ceil(F.greatest(F.col("texts") / block_texts, F.col("load") / block_ngrams)).cast("int")
    buckets = buckets.withColumns({"blocks": blocks, "of": F.monotonically_increasing_id()})
    buckets = materialize(buckets.withColumnsRenamed({"band": "b_band", "h": "b_h"}), "ngram-buckets")
    small = buckets.where("blocks = 1").agg(F.sum("load")).first()[0] or 0
    packs = max(1, math.ceil(2 * small / block_ngrams))  # small buckets share tiles of bounded size, those with a common first class the same
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("low"), F.lit(packs)) - packs).otherwise(F.col("of"))
    mine = F.pmod(F.xxhash64("cid", "of"), F.col("blocks").cast("long")).cast("int")
    held = banded.join(buckets, (F.col("h") == F.col("b_h")) & (F.col("band") == F.col("b_band"))).select("cid", pack.alias("pack"), "of", "band", "blocks", mine.alias("mine"))
    slots = held.groupBy("cid").agg(F.collect_list(F.struct("pack", "of", "band", "blocks", "mine")).alias("slots"))  # at most one a band
    dealt = classes.select("cid", "rep", "copies", "bands").join(slots, "cid")
    dealt = materialize(dealt.select(F.col("rep.doc_id").alias("m_id"), F.col("rep.key").alias("m_key"), "cid", "copies", "bands", "slots"), "ngram-members")
    texts = docs.select("doc_id", row_key().alias("key"), "text")
    joined = texts.join(dealt, (F.col("key") == F.col("m_key")) & F.col("doc_id").eqNullSafe(F.col("m_id")))

    def places(slot: F.Column) -> F.Column:
        """The tiles of one slot: its block with each block of its bucket."""
        return F.transform(F.sequence(F.lit(0), slot["blocks"] - 1), lambda o: F.struct(slot["pack"].alias("pack"), F.least(slot["mine"], o).alias("i"), F.greatest(slot["mine"], o).alias("j")))

    # a text travels once to each tile, with all its buckets there
    where = F.explode(F.array_distinct(F.flatten(F.transform("slots", places)))).alias("t")
    tiles = joined.select("cid", "copies", "bands", "slots", "text", where)
    tiles = tiles.select("t.pack", "t.i", "t.j", "cid", "copies", "bands", "text", F.filter("slots", lambda s: s["pack"] == F.col("t.pack")).alias("slots"))

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        _, first = np.unique(table.column("cid").to_numpy(), return_index=True)  # a repeated row joins twice
        table = table.take(first)  # in order of cid, so a root is the smallest
        cid, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        hashes = np.frombuffer(b"".join(table.column("bands").to_pylist()), np.uint64).reshape(len(cid), bands)
        sets = [ngram_set(text.as_py(), words) for text in table.column("text")]
        forget_words()
        slots = table.column("slots").combine_chunks()
        row = np.repeat(np.arange(len(cid)), slots.value_lengths().to_numpy())
        of, band, mine = (slots.flatten().field(c).to_numpy() for c in ("of", "band", "mine"))
        order = np.lexsort((row, of))
        one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            own = row[at]
            a, b = verified_pairs([sets[k] for k in own], hashes[own, : band[at[0]] + 1], mine[at] == i, threshold, cross=i != j)
            one.append(own[a])
            two.append(own[b])
        a, b = np.concatenate(one), np.concatenate(two)
        links = np.zeros(len(cid), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        low = cid[forest(len(cid), a, b)]
        linked = links > 0
        give_back()
        return pa.table({"cid": cid[linked], "links": links[linked], "low": low[linked]})

    found = materialize(tiles.groupBy("pack", "i", "j").applyInArrow(tile, "cid long, links long, low long"), "ngram-links")
    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("low < cid").select(F.col("cid").alias("a"), F.col("low").alias("b")), name="ngram-groups").withColumnsRenamed({"id": "g_cid", "component": "group"})
    named = classes.select("set_id", "cid", "rep", "low_id", "copies").join(linked.withColumnRenamed("cid", "l_cid"), F.col("cid") == F.col("l_cid"), "left").join(groups, F.col("cid") == F.col("g_cid"), "left")
    named = materialize(named.select("set_id", "rep", "low_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "cid").alias("group")), "ngram-named")
    tops = materialize(named.groupBy("group").agg(F.min("low_id").alias("class_id"), F.min("rep").alias("top")).withColumnRenamed("group", "t_group"), "ngram-tops")
    named = materialize(named.join(tops, F.col("group") == F.col("t_group")).select(F.col("set_id").alias("c_set"), "class_id", "top", "copies", "links"), "ngram-classes-named")
    discard(classes, buckets, dealt, found, tops)  # what is left is read from the signatures and the named classes
    done = sigs.select("doc_id", "key", "set_id").join(named, F.col("set_id") == F.col("c_set"), "left")
    alone = F.col("set_id").isNull()
    return done.select(
        "doc_id", "key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("copies"),
        (alone | F.struct("doc_id", "key").eqNullSafe(F.col("top"))).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id; columns as they were.
    Of rows that repeat with id and text one stays, whatever their other columns; rows without words all stay."""
    found = ngram_join(docs, **how)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key")).distinct()
    # every column travels under another name, so that none clashes with those made here
    own = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    keyed = docs.select(*(docs[c].alias(n) for c, n in own.items()), docs["doc_id"].alias("row_id")).withColumn("row_key", row_key(own["text"]))
    left = keyed.join(gone, (F.col("row_key") == F.col("g_key")) & F.col("row_id").eqNullSafe(F.col("g_id")), "left_anti")
    repeated = found.where("kept and copies > 1").groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias("r_id"), F.col("key").alias("r_key"))
    if repeated.limit(1).count():
        same = (F.col("row_key") == F.col("r_key")) & F.col("row_id").eqNullSafe(F.col("r_id"))
        left = left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates(["row_id", "row_key"]))
    return left.select(*(F.col(n).alias(c) for c, n in own.items()))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies", "kept")
