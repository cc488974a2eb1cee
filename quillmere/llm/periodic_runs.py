"""Periodic runs of words, by Lyndon arrays on an ordered alphabet.

Every run is generated by a Lyndon word of the order of words or of its reverse: the word from ``i`` to the next smaller suffix of ``i``
(Bannai et al., 2017). Both Lyndon arrays and the matches to their right are found in one pass each from left to right, after
Ellert and Fischer (2021): only words are compared, and what a comparison has matched is used again instead of being matched anew. No
suffix array, no hash of a stretch and no fingerprint is needed, and the number of comparisons is linear in the text's words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import read_table, text_chunks

#: A run has at least so many words and repeats its period at least so often.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Text that is worked on at a time in a task, unless one document has more.
CHUNK_BYTES = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"
_word = re.compile(WORD)


def lyndon_array(w: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next smaller suffix, and how many words the two suffixes share; the end of the text is the smallest.

    Suffix ``i`` meets the chain of previous smaller suffixes, nearest first, and takes itself off those that are greater. What it shares
    with the chain's members is known from what they share with each other, unless that is equal; only then are words compared,
    from there on. ``[near, i)`` and ``reach``: the stretch matched farthest to the right. A place inside it does what its copy
    ``shift`` places before did, and compares words only beyond ``reach``; so each word is matched once.
    """
    n = len(w)
    before, shared = [-1] * n, [0] * n  # previous smaller suffix, and the words shared with it
    after, match = [n] * n, [0] * n  # next smaller suffix, and the words shared with it
    most = [0] * n  # the most words that a place shared with one of the chain
    reach = shift = 0
    for i in range(1, n):
        j, m = i - 1, 0
        if i < reach:
            k = i - shift
            m = most[k]
            if i + m < reach:  # all that decided the copy lies inside
                stop = before[k] + shift
                while j != stop:
                    after[j] = i
                    match[j] = match[j - shift]
                    j = before[j]
                before[i], shared[i], most[i] = stop, shared[k], m
                continue
            while True:
                e = j - shift
                m = match[e] if after[e] == k else shared[k]
                if i + m >= reach:
                    break
                after[j], match[j] = i, m
                j = before[j]
            m = reach - i
        elif w[j] < w[i]:
            before[i] = j
            continue
        near = j
        while j >= 0:
            start, a, b = m, j + m, i + m
            while b < n and w[a] == w[b]:
                a += 1
                b += 1
            m = b - i
            if m > start:
                near = j
            if b < n and w[a] < w[b]:
                before[i], shared[i] = j, m
                break
            after[j], match[j] = i, m
            known, j = shared[j], before[j]
            while j >= 0 and m < known:  # as far as i goes, this one is like the last
                after[j], match[j] = i, m
                known, j = shared[j], before[j]
            if j >= 0 and m > known:  # it fell below the last where i still agreed with that
                before[i], shared[i] = j, known
                break
        most[i] = m
        if m and i + m >= reach:
            reach, shift = i + m, i - near
    return after, match


def runs_of(words: list[str], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, sorted by start, then period."""
    n = len(words)
    if n < max(least, times):
        return []
    rank = {x: k for k, x in enumerate(sorted(set(words)))}
    up = [rank[x] for x in words]
    place, found = np.arange(n), {}
    for w in (up, [-x for x in up]):
        after, match = (np.asarray(x) for x in lyndon_array(w))
        period = after - place
        # from its first Lyndon root on a run has all but fewer words than one period
        able = np.flatnonzero(match + 2 * period > np.maximum(least, times * period))
        for i, q, end in zip(able.tolist(), period[able].tolist(), (after + match)[able].tolist()):
            if (end, q) not in found:
                start = i
                while start and up[start - 1] == up[start - 1 + q]:
                    start -= 1
                found[end, q] = start
    return sorted((start, end - start, q) for (end, q), start in found.items() if end - start >= max(least, times * q))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without what repeats: of each run its first period stays, unless another run drops it."""
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        drop[start + q] += 1
        drop[start + length] -= 1
    return " ".join(x for x, d in zip(words, np.cumsum(drop).tolist()) if not d)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _task(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, CHUNK_BYTES):
            sizes, runs, left = [], [], []
            for text in batch.column("text").to_pylist():
                words = _word.findall(text or "")
                found = runs_of(words, least, times)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                left.append(collapsed(words, found) if found else " ".join(words))
            own = [batch.column(k) for k, c in enumerate(batch.schema.names) if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(left, pa.string())], names=[*names, "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_TIMES, identity: str = "doc_id") -> DataFrame:
    """Per row the identity, ``n_words``, ``runs`` (array of start, length and period, sorted by start and period) and ``collapsed``, the words
    without repeats joined by one space.

    A run is a stretch of consecutive words with smallest period ``period``, at least ``least`` words and ``times`` periods long, that no
    neighbour extends. A null or empty text has no words and an empty ``collapsed``; rows are judged one by one, so repeated rows
    and null ids each stay; other columns do not matter. A document is one task's work, linear in its words.
    """
    rows = docs.select(identity, "text")
    kind = rows.schema[identity].dataType.simpleString()
    return rows.mapInArrow(_task(least, times), f"`{identity}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(text: Column, identity: Column) -> Column:
    """A tenth of the texts, by ``h = crc32(identity)``, with a tail that repeats: with ``g = h / 10``, from word ``g % n`` on with a period of
    ``1 + (n - g % n) / (3 + g % 8)``. A null text or identity changes nothing."""
    h = F.crc32(identity.cast("string"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        at = g % n
        period = 1 + F.floor((n - at) / (3 + g % 8))
        turned = F.transform(F.array(F.struct(at.alias("a"), period.alias("p"))), lambda s: F.transform(words, lambda x, i: F.when(i >= s["a"], F.get(words, (s["a"] + (i - s["a"]) % s["p"]).cast("int"))).otherwise(x)))[0]
        return F.when(n > 0, F.array_join(turned, " ")).otherwise(text)

    return F.when(h % 10 == 0, F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), tail)[0]).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    told = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    # runs are sorted by start and period, so the first of equals is the one that counts; ratios are compared without division
    most = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    told = told.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("most"), listed.alias("listed"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exact = F.expr("1000 * most.length div most.period")
    lines = F.when(F.col("n_runs") > 0, F.concat("listed", F.lit("\n"))).otherwise("")
    return told.select("doc_id", "n_runs", "most.start", "most.length", "most.period", exact.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256")
