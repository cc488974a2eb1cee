import itertools
import random

import numpy as np

from quillmere.llm.quality import line_statistics, marginals, quality_score, split_lines, train, with_neighbours


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(2)
    counts = np.array([3, 0, 1, 5])
    emit, trans = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    p, pairs, log_z = marginals(emit, trans, counts)
    want_pairs, want_z, at = np.zeros((2, 2)), 0.0, 0
    for c in counts:
        if not c:
            continue
        e = emit[at : at + c]
        weight = {y: np.exp(sum(e[t, y[t]] for t in range(c)) + sum(trans[y[t], y[t + 1]] for t in range(c - 1))) for y in itertools.product((0, 1), repeat=int(c))}
        z = sum(weight.values())
        want_z += np.log(z)
        for t in range(c):
            assert np.isclose(p[at + t, 1], sum(v for y, v in weight.items() if y[t]) / z)
        for y, v in weight.items():
            for t in range(c - 1):
                want_pairs[y[t], y[t + 1]] += v / z
        at += c
    assert np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_lines_alike_beside_other_texts():
    texts = ["One line.\nTWO!!\n\nOne line.", "", "é | ü | x", "a" * 5000]
    lines, counts = split_lines(texts)
    assert counts.tolist() == [3, 0, 1, 1]
    x, _ = line_statistics(lines, counts)
    assert x[:, 11].tolist() == [0, 0, 1, 0, 0]
    at = 0
    for t, c in zip(texts, counts, strict=True):
        alone = line_statistics(*split_lines([t]))[0]
        assert np.allclose(alone, x[at : at + c])
        at += c
    near = with_neighbours(x, counts)
    assert np.allclose(near[0, 13:26], 0) and np.allclose(near[1, 13:26], x[0]) and np.allclose(near[2, 26:], 0)


def test_learns_and_keeps_rows(spark):
    rng = random.Random(4)
    words = "house street water people morning evening letter paper".split()
    rows = []
    for k in range(400):
        good = k % 4 > 0
        lines = [" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(rng.randrange(2, 8))]
        if not good:
            lines = [" ".join(rng.choice(words).upper() + "!!" for _ in range(12)) for _ in lines]
        rows.append(("\n".join(lines), int(good)))
    trained = train(spark.createDataFrame([*rows, (None, 1), ("x", None)], "text string, quality int"))
    ask = [(k, t, "x") for k, (t, _) in enumerate(rows)] + [(1000, None, None), (1001, "", "x"), (1002, "\n \n", "x"), (0, rows[0][0], "x"), (1003, rows[1][0] * 2000, "x")]
    got = quality_score(spark.createDataFrame(ask, "doc_id long, text string, score string"), trained).collect()
    assert len(got) == len(ask)
    assert all(r.score == 1 / 2 and r.predicted == 1 for r in got if r.doc_id in (1000, 1001, 1002))  # as the one blank text labelled says
    assert all(r.predicted == rows[r.doc_id][1] for r in got if r.doc_id < 400)
    assert next(r for r in got if r.doc_id == 1003).predicted == 1


def test_nothing_labelled(spark):
    trained = train(spark.createDataFrame([], "text string, quality int"))
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert 0 <= quality_score(df, trained).first().score <= 1
    assert quality_score(df.limit(0), trained).count() == 0


def test_blank_texts_as_labels_say(spark):
    rows = [("", 1)] * 3 + [(None, 1)] * 4 + [("Good words here.", 1), ("##|##", 0)] * 5
    trained = train(spark.createDataFrame(rows, "text string, quality int"))
    assert trained["empty"] == 7 / 8
    got = quality_score(spark.createDataFrame([(1, None), (2, " \n")], "doc_id long, text string"), trained).collect()
    assert [r.score for r in got] == [7 / 8] * 2 and all(r.predicted == 1 for r in got)
