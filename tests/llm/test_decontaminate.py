import random
import tracemalloc

import numpy as np
import pyarrow as pa

from quillmere.llm.decontaminate import Finder, benchmark_matches, best_match, decontaminate, embed, searched, words_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for k, y in enumerate(b, 1):
            new.append(min(row[k - 1] + (x != y), row[k] + 1, new[k - 1] + 1))
        row = new
    return row[-1]


def brute(item, text, most):
    """Fewest edits to any stretch of the text."""
    found = min(distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, min(len(text), a + 2 * len(item)) + 1))
    return found if found <= most else None


WORDS = [f"word{k}" for k in range(400)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k, how = rng.randrange(len(words)), rng.randrange(3)
        if how == 0:
            words[k] = rng.choice(WORDS)
        elif how == 1:
            del words[k]
        else:
            words.insert(k, rng.choice(WORDS))
    return words


def test_best_match_against_brute_force():
    rng = random.Random(0)
    for _ in range(40):
        item = [rng.randrange(6) for _ in range(6)]
        text = [rng.randrange(6) for _ in range(12)]
        for most in (1, 3):
            got = best_match(item, text, most)
            assert (got and got[0]) == brute(item, text, most)


def test_walk_keeps_equal_windows_equal():
    words = np.array([5, 7, 9, 11, 5, 7, 9, 11, 0, 0], np.uint64)
    a = embed(words, np.array([0, 4]), 4, 1)
    assert (a[:, 0] == a[:, 1]).all()
    cut = embed(words, np.array([0]), 2, 1)[:, 0]
    assert set(cut.tolist()) <= {0, 5, 7}


def test_recall_at_the_most_edits():
    """Each planted passage has as many edits as are allowed."""
    rng = random.Random(7)
    items = [(k, [rng.choice(WORDS) for _ in range(rng.choice([15, 30, 55]))]) for k in range(120)]
    texts = []
    for _, ws in items:
        around = [rng.choice(WORDS) for _ in range(120)]
        texts.append(" ".join([*around[:60], *edited(rng, ws, int(0.2 * len(ws))), *around[60:]]))
    found = Finder(items).search(texts)
    hit = sum(any(m[0] == k for m in of) for k, of in enumerate(found))
    assert hit >= 0.95 * len(items), hit
    for k, of in enumerate(found[:4]):  # what is reported is verified exactly
        for at, edits, start in of:
            near = words_of(texts[k])[start : start + 2 * len(items[at][1])]
            assert edits == min(distance(items[at][1], near[:n]) for n in range(len(near) + 1)) <= int(0.2 * len(items[at][1]))


def test_exact_and_lightly_edited_always(spark):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(25))) for k in range(30)]
    items += [(900, "one two"), (901, ""), (902, None), (None, "x y z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for k in range(30):
        around = " ".join(rng.choice(WORDS) for _ in range(80))
        passage = " ".join(edited(rng, items[k][1].split(), k % 3)).capitalize().replace(" ", ", ", 2)
        rows.append((k, f"{around}. {passage}! {around}", "x"))
    rows += [(100, " ".join(rng.choice(WORDS) for _ in range(500)), "x"), (101, None, "x"), (102, "", "x"), (0, rows[0][1], "x"), (None, rows[1][1], "x"), (103, "filler " * 30_000 + items[4][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id) for r in benchmark_matches(df, bench).collect()}
    assert got == {(k, k) for k in range(30)} | {(None, 1), (103, 4)}
    assert got == {(r.doc_id, r.item_id) for r in benchmark_matches(df, bench, pass_bytes=1500).collect()}  # in several passes
    clean = decontaminate(df, bench)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [100, 101, 102]
    assert decontaminate(df.limit(0), bench).count() == 0 and decontaminate(df, bench.limit(0)).count() == len(rows)


def edited_by(rng, words, edits, how):
    """The words after so many edits of one kind (0 replaced, 1 left out, 2 put in, 3 mixed), the first and last words kept."""
    words, fresh = list(words), iter(range(10**6))
    for _ in range(edits):
        k, kind = rng.randrange(1, len(words) - 1), rng.randrange(3) if how == 3 else how
        if kind == 0:
            words[k] = f"other{next(fresh)}"
        elif kind == 1:
            del words[k]
        else:
            words.insert(k, f"other{next(fresh)}")
    return words


def test_no_passage_is_lost_by_kind_of_edit_and_length():
    rng = random.Random(5)
    for length in (4, 5, 7, 16, 30, 60, 100, 200, 300):
        for how in range(4):
            items = [(k, [f"w{rng.randrange(10**6)}" for _ in range(length)]) for k in range(25 if length <= 60 else 8)]
            texts = []
            for _, ws in items:
                around = [rng.choice(WORDS) for _ in range(120)]
                texts.append(" ".join([*around[:60], *edited_by(rng, ws, int(0.2 * length), how), *around[60:]]))
            found = Finder(items).search(texts)
            assert [[m[0] for m in of] for of in found] == [[k] for k in range(len(items))], (length, how)


def test_finds_what_all_stretches_hold():
    """Against the edit distances of all stretches, with few words, so that many stretches come close."""
    rng = random.Random(9)
    items = [(k, [f"v{rng.randrange(9)}" for _ in range(rng.choice([1, 2, 3, 5, 6, 10, 11]))]) for k in range(12)]
    texts = [[f"v{rng.randrange(9)}" for _ in range(rng.randrange(30))] for _ in range(12)]
    texts += [edited(rng, ws, int(0.2 * len(ws))) if len(ws) > 3 else ws for _, ws in items]
    found = Finder(items).search([" ".join(t) for t in texts])
    for text, of in zip(texts, found, strict=True):
        wanted = {(k, e) for k, ws in items if (e := brute(ws, text, int(0.2 * len(ws)))) is not None}
        assert {(k, e) for k, e, _ in of} == wanted


def test_equal_items_and_ties(spark):
    """Items with equal words are found each; of equally good places the first counts."""
    words = " ".join(f"word{k}" for k in range(12))
    bench = spark.createDataFrame([(k, words) for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before it {words} and {words} after"), (2, "nothing of it")], "doc_id long, text string")
    got = benchmark_matches(docs, bench).collect()
    assert sorted(r.item_id for r in got) == list(range(40)) and {(r.doc_id, r.edits, r.first_word) for r in got} == {(1, 0, 2)}
    assert [r.doc_id for r in decontaminate(docs, bench).collect()] == [2]


def test_a_pass_is_bounded_for_a_large_benchmark(spark):
    """8 MB of benchmark: the tables of one pass stay below 50 MB, and the passes hold all of it."""
    import pickle

    from quillmere.llm.decontaminate import PASS_BYTES, slices

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20_000)]
    items = [(k, " ".join(rng.choices(words, k=60))) for k in range(20_000)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert sum(len(t) for _, t in items) > 8_000_000
    finder = next(slices(benchmark))
    assert len(pickle.dumps(finder)) < 50_000_000 and 1_000 < len(finder.items) < 20_000 * PASS_BYTES / 8_000_000


def test_passes_are_written_one_after_another(spark):
    items = [(k, " ".join(f"q{k}w{j}" for j in range(12))) for k in range(40)]
    docs = spark.createDataFrame([(k, f"before {items[k][1]} after") for k in range(0, 40, 3)] + [(100, "nothing of it here at all")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in benchmark_matches(docs, benchmark, pass_bytes=600).collect())
    assert got == [(k, k) for k in range(0, 40, 3)]
    assert [r.doc_id for r in decontaminate(docs, benchmark, pass_bytes=600).collect()] == [100]


def test_memory_of_a_large_batch():
    """A batch of 8 MB is searched in slices: what is held at once stays far below the 65 MB that searching it whole takes, and every text is answered."""
    rng = random.Random(3)
    item = [rng.choice(WORDS) for _ in range(30)]
    texts = [" ".join(rng.choices(WORDS, k=400)) for _ in range(2600)]
    held = {0, 1300, 2599}
    for k in held:
        texts[k] += " " + " ".join(item)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    finder = Finder([(1, item)])
    tracemalloc.start()
    found = [m for _, of in searched(finder, [batch]) for m in of]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(texts) and {k for k, m in enumerate(found) if m} == held
    assert most < 40 << 20
