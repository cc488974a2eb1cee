import hashlib
import random

import numpy as np
import pytest

from quillmere.llm.suffix_dedup import COVER, PERIOD, remove_repeats, sort_suffixes, stretches


def brute(rows, length=100):
    """All strings of the length in a dictionary, in order of (id, place)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for p in range(len(b) - length + 1):
            key, place = b[p : p + length], (i is None, i or 0, p)
            first[key] = min(first.get(key, place), place)
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (i is None, i or 0, p):
                gone[p : p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((-1 if i is None else i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def some_rows(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = []
    for k in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(2)]
        if k % 2:
            p = rng.choice(passages)
            a = rng.randrange(30)
            parts.insert(1, p[a : a + rng.randrange(90, 200)])
        if k % 5 == 0:
            parts.append("ab" * rng.randrange(200))
        rows.append((k, "".join(parts)))
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, None), (n + 3, "")]


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    assert max(min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)) < 8


def test_sort_tells_equal_strings():
    rng = np.random.default_rng(0)
    data = np.frombuffer(rng.integers(97, 99, 3000).astype(np.uint8).tobytes() + b"ab" * 500 + b"ab" * 500 + bytes(16), np.uint8)
    at = np.arange(0, len(data) - 140)
    rank = sort_suffixes(data, at, at * 0 + 0, 100)
    seen = {}
    for r, p in zip(rank.tolist(), at.tolist()):
        key = (data[p : p + 100].tobytes(), min((c - p) % PERIOD for c in COVER))
        assert seen.setdefault(key, r) == r
    assert len(set(seen.values())) == len(seen)


def test_stretches_cover_each_suffix_once():
    rng = random.Random(2)
    parts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (0, 99, 100, 101, 400, 0, 1000)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    begin, count, at, h = stretches(data, np.cumsum([len(p) for p in parts]))
    covered = sorted(p for b, c in zip(begin.tolist(), count.tolist()) for p in range(b, b + c))
    base, want = 0, []
    for p in parts:
        want += range(base, base + max(0, len(p) - 99))
        base += len(p)
    assert covered == want
    assert ((at >= begin) & (at + 24 <= begin + count + 99)).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = some_rows(seed)
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_bytes int").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect())
    assert got == brute(rows)


def test_repeated_rows_nulls_and_long(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(60_000)) + "h" * 500
    rows = [(1, long), (1, long), (2, long[500:900]), (None, long[:300]), (None, long[100:400]), (3, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect())
    assert got == brute(rows)
    assert remove_repeats(df.limit(0)).count() == 0


def test_a_passage_in_many_chunks(spark, monkeypatch):
    """With tiny chunks every task meets the passage again and again, ids in no order."""
    from quillmere.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 2_000)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(200)) + passage + passage[: k * 3]) for k in rng.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect())
    assert got == brute(rows)


def test_minimizers_do_not_depend_on_the_chunk():
    rng = random.Random(5)
    text = bytes(rng.choice(b"abc") for _ in range(700))
    data = np.frombuffer(text, np.uint8)
    alone = stretches(data, np.array([len(text)]))
    long = np.frombuffer(text + bytes(rng.choice(b"abc") for _ in range(300_000)), np.uint8)
    beside = stretches(long, np.array([len(text), len(long)]))
    n = len(alone[0])
    for a, b in zip(alone, beside, strict=True):
        assert a.tolist() == b[:n].tolist()


def test_other_ids_are_refused(spark):
    with pytest.raises(TypeError):
        remove_repeats(spark.createDataFrame([("a", "text")], "doc_id string, text string"))
