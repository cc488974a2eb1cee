import math

import numpy as np

from quillmere.llm.embedding_dups import forest, near_duplicate_vectors, possible, quantise

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.98):
    """Links and smallest reachable id by plain double-precision cosines."""
    def unit(e):
        if not e or any(v is None or not math.isfinite(v) for v in e) or not any(e):
            return None
        x = np.array(e, np.float32).astype(float)
        return x / np.linalg.norm(x)
    vs = [(i, unit(e), lab) for i, e, lab, *_ in rows]
    n = len(vs)
    near = [[b for b in range(n) if a != b and vs[a][1] is not None and vs[b][1] is not None and vs[a][2] is not None and vs[a][2] == vs[b][2] and len(vs[a][1]) == len(vs[b][1]) and vs[a][1] @ vs[b][1] >= threshold] for a in range(n)]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        low = min(vs[b][0] for b in seen)
        out.append((vs[a][0], len(near[a]), low, vs[a][0] == low))
    return sorted(out)


def some_rows(seed=1, n=120, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        x = rng.normal(size=dim)
        if k % 3 == 0 and rows:
            base = rows[rng.integers(len(rows))][1]
            x = np.array(base) + rng.normal(size=dim) * rng.choice([0.0, 0.02, 0.1, 0.2])
        rows.append((k, [float(np.float32(v)) for v in x], int(k % 2), "x"))
    return rows


def test_bound_is_rigorous():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 24)) * np.exp(rng.normal(size=(300, 24)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.03
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = x @ y.T
    for t in (0.9, 0.98, 0.999):
        may = possible(quantise(x), quantise(y), t)
        assert may[cos >= t].all() and may.mean() < 0.2


def test_forest():
    assert forest(6, np.array([5, 3, 1]), np.array([3, 1, 4])).tolist() == [0, 1, 2, 1, 1, 1]
    assert forest(3, np.array([], int), np.array([], int)).tolist() == [0, 1, 2]


def test_against_brute_force(spark):
    rows = some_rows()
    rows += [(500, None, 0, "x"), (501, [0.0] * 16, 0, "x"), (502, [float("nan")] * 16, 0, "x"), (503, [1.0, None], 0, "x"), (504, rows[0][1], None, "x"), (505, rows[0][1], 0, "x"), (506, [], 1, "x"), (507, [2.0, 0.0], 0, "x"), (508, [4.0, 0.0], 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (2048, 16):  # one tile a label, and many
        got = sorted(tuple(r) for r in near_duplicate_vectors(df, block=block).collect())
        assert got == brute(rows)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 3, ""), (1, [1.0, 0.0], 3, "")], SCHEMA)
    assert near_duplicate_vectors(df.limit(0)).count() == 0
    assert [tuple(r) for r in near_duplicate_vectors(df).collect()] == [(1, 1, 1, True)] * 2


def test_ids_that_repeat_with_other_vectors_or_labels(spark):
    rows = [(1, [1.0, 0.0], 0, ""), (1, [0.0, 1.0], 0, ""), (1, [1.0, 0.0], 1, ""), (2, [0.999, 0.01], 0, ""), (3, [0.0, 1.0], 0, ""), (4, [1.0, 0.01], 1, "")]
    got = sorted(tuple(r) for r in near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows) == [(1, 1, 1, True)] * 3 + [(2, 1, 1, False), (3, 1, 1, False), (4, 1, 1, False)]
