import random

import numpy as np
import pytest

from quillmere.llm.ngram_join import _overlaps, choose_bands, keep_one_of_each, ngram_join, ngram_set, verified_pairs


def brute(rows, threshold=0.8):
    """Links and smallest reachable id by plain sets of word tuples."""
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets = [grams(t) for _, t in rows]
    near = [[b for b in range(len(rows)) if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold] for a in range(len(rows))]
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((rows[a][0] or -1, min(ids) if ids else None, len(near[a])))
    return sorted(out)


def some_rows(seed=0, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(n):
        if k % 2 and rows:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([6, 40, 120]))]
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("t, r", [(0.8, 0.999), (0.9, 0.99), (0.5, 0.95)])
def test_bands_reach_the_recall(t, r):
    bands, rows = choose_bands(t, r)
    assert 1 - (1 - t**rows) ** bands >= r and bands * rows <= 128


def test_overlaps_against_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(70)]
    got = _overlaps(sets)
    for a in range(70):
        for b in range(a + 1, 70):
            assert got[a, b] == len(set(sets[a].tolist()) & set(sets[b].tolist()))


def test_dense_and_sparse_ways_agree():
    rows = some_rows(4, 200)
    sets = [ngram_set(t) for _, t in rows]
    same = np.zeros((200, 1), np.uint64)
    a, b = verified_pairs(sets, same, np.ones(200, bool), 0.8)  # all in one bucket: by matrix
    want = [(x, y) for x in range(200) for y in range(x + 1, 200) if len(np.intersect1d(sets[x], sets[y])) / len(np.union1d(sets[x], sets[y])) >= 0.8]
    assert list(zip(a.tolist(), b.tolist())) == want
    side = np.arange(200) % 2 == 0
    a, b = verified_pairs(sets, same, side, 0.8)
    assert list(zip(a.tolist(), b.tolist())) == [p for p in want if side[p[0]] != side[p[1]]]


@pytest.mark.parametrize("block", [2048, 7])
def test_against_brute_force(spark, block):
    rows = some_rows() + [(100, None), (101, ""), (102, " \n"), (103, "two words"), (104, "TWO words"), (3, some_rows()[3][1]), (None, some_rows()[5][1]), (105, "long " * 30_000), (106, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    got = sorted(((r.doc_id or -1), r.class_id, r.n_links) for r in ngram_join(df, block_texts=block).collect())
    assert [(a if a != 0 else -1, b, c) for a, b, c in got] == [(a, b, c) for a, b, c in brute(rows)]


def test_keep_one(spark):
    rows = [(5, "a b c d e f g h", "x"), (2, "a b c d e f g h", "y"), (2, "a b c d e f g h", "z"), (7, None, "n"), (8, None, "n"), (9, "other words are here now", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8, 9]
    assert keep_one_of_each(df.limit(0)).count() == 0


def test_links_count_once_where_a_block_is_empty(spark):
    """Two long near copies that fall into the same one of two blocks."""
    words = [f"w{k}" for k in range(1_000)]
    rows = [(k, " ".join([*words[: 50 * k], f"changed{k}", *words[50 * k :]])) for k in range(2)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), block_ngrams=1_000).collect())
    assert got == [(0, 0, 1), (1, 0, 1)]


def test_rows_without_words_stay_whatever_else_is_there(spark):
    empty = [(7, None, "a"), (7, None, "b"), (7, "", "c"), (None, " ", "d")]
    other = [(1, "some words that repeat here", "x")] * 2
    for rows in (empty, empty + other):
        kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert sorted(r.source for r in kept) == ["a", "b", "c", "d"] + ["x"] * (len(rows) > 4)


def test_pairs_count_once_over_all_their_bands(spark):
    """A cluster of near copies shares most bands, in tiles of many blocks; each link counts once, and all are found."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(40):
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(300)] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for block in (1024, 6):
        got = sorted((r.doc_id or -1, r.class_id, r.n_links) for r in ngram_join(df, block_texts=block).collect())
        assert got == want


def test_recall_by_similarity():
    """Share of pairs that meet in a band, by their similarity, against what banding promises."""
    bands, size = choose_bands(0.8, 0.999)
    from quillmere.llm.ngram_join import seeds_for, signature

    rng, seeds = np.random.default_rng(6), seeds_for(bands * size)
    for similarity in (0.5, 0.6, 0.7, 0.8, 0.9, 1.0):
        hits = 0
        for _ in range(400):
            both = round(200 * 2 * similarity / (1 + similarity))
            own = rng.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64)
            a, b = np.unique(own[:200]), np.unique(np.concatenate([own[:both], own[200 : 400 - both]]))
            hits += bool((signature(a, seeds, bands) == signature(b, seeds, bands)).any())
        promised = 1 - (1 - similarity**size) ** bands
        assert abs(hits / 400 - promised) < 0.08, (similarity, hits / 400, promised)
        assert similarity < 0.8 or hits / 400 > 0.99


def test_columns_of_any_name_travel(spark):
    names = ["_row_key", "row_key", "row_id", "g_id", "g_key", "r_id", "r_key", "key", "own_0", "kept", "set_id", "class_id"]
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(k, t, *(100 * k + i for i in range(len(names)))) for k, t in enumerate([words, words, words + " end", "another text of six words here", None])]
    rows += [rows[0], rows[3], rows[4]]  # repeated rows too
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted([rows[0], rows[3], rows[4], rows[4]])
