"""Balanced assignment, suppression and matching against all possibilities of small cases."""

import hashlib
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmere.operators import partition as part


@pytest.mark.parametrize(("n", "k", "seed"), [(7, 3, 0), (8, 3, 1), (6, 2, 2), (6, 3, 3), (7, 4, 4), (2, 3, 5), (1, 1, 6), (7, 3, 7), (8, 2, 8)])
def test_balance_is_best(n, k, seed):
    sim = np.random.default_rng(seed).normal(size=(n, k)) + np.linspace(0, 2, k)
    own = part.balance(sim)
    fits = lambda a: np.ptp(np.bincount(a, minlength=k)) <= 1
    best = max(sim[np.arange(n), list(a)].sum() for a in itertools.product(range(k), repeat=n) if fits(list(a)))
    assert fits(own) and sim[np.arange(n), own].sum() == pytest.approx(best)


def test_balance_of_equal_rows():
    assert sorted(np.bincount(part.balance(np.zeros((10, 4))))) == [2, 2, 3, 3]


def drawn(spark, rng, sizes, k, copies=0):
    """Vectors of labels with the given sizes, the last ``copies`` of each equal, and centres; a lopsided cloud, so that most like the same centre."""
    rows, n = [], 0
    for label, size in enumerate(sizes):
        x = np.round(rng.normal(size=(size, 3)) + [1.0, 0.5, 0.0], 3)
        x[size - copies :] = x[0]
        rows += [(n + i, label, v) for i, v in enumerate(x.tolist())]
        n += size
    centres = [(label, c, rng.normal(size=3).round(3).tolist()) for label in range(len(sizes)) for c in range(k)]
    vectors = spark.createDataFrame(pd.DataFrame(rows, columns=["vec_id", "label", "unit"]), "vec_id long, label int, unit array<double>")
    return vectors, spark.createDataFrame(centres, "label int, cluster int, centre array<double>"), rows, centres


@pytest.mark.parametrize(("sizes", "k", "copies", "held", "seed"), [([80, 41], 3, 0, 10**6, 0), ([80, 41], 3, 30, 10**6, 1), ([120, 7, 5], 4, 3, 40, 2), ([60], 5, 59, 30, 3), ([300], 2, 100, 4, 4)])
def test_balanced_assignment_is_best(spark, monkeypatch, sizes, k, copies, held, seed):
    monkeypatch.setattr(part, "HELD_KINDS", held)
    vectors, centres, rows, given = drawn(spark, np.random.default_rng(seed), sizes, k, copies)
    vectors = vectors.unionByName(spark.createDataFrame([(10_000, None, [1.0, 0.0, 0.0])], vectors.schema))
    got = {r.vec_id: r.cluster for r in part.balanced_assignment(vectors, centres).collect()}
    assert set(got) == {i for i, *_ in rows}
    for label in range(len(sizes)):
        x = np.array([v for _, l, v in rows if l == label])
        sim = np.round(x @ np.array([c for l, _, c in given if l == label]).T, 9)
        own = np.array([got[i] for i, l, _ in rows if l == label])
        places = part.capacities(sim)
        assert np.bincount(own, minlength=k).tolist() == places.tolist()
        best = part.balance(sim, places)
        at = np.arange(len(sim))
        assert sim[at, own].sum() == pytest.approx(sim[at, best].sum(), abs=1e-9)


def test_balanced_assignment_of_a_large_label(spark):
    """50,000 vectors of one label, a third of them copies: sizes differ by one, and prices exist that no vector would leave its column for."""
    vectors, centres, rows, given = drawn(spark, np.random.default_rng(7), [50_000], 4, 16_000)
    got = part.balanced_assignment(vectors.repartition(8), centres).toPandas().set_index("vec_id")["cluster"]
    own = got.loc[range(50_000)].to_numpy()
    assert np.ptp(np.bincount(own, minlength=4)) <= 1
    sim = np.round(np.array([v for _, _, v in rows]) @ np.array([c for _, _, c in given]).T, 9)
    # no cycle of moves between columns gains: cheapest losses have no negative cycle
    loss = np.array([[(sim[own == a, a] - sim[own == a, b]).min() if a != b else 0.0 for b in range(4)] for a in range(4)])
    for m in range(4):
        loss = np.minimum(loss, loss[:, m : m + 1] + loss[m : m + 1])
    assert np.diag(loss).min() > -1e-8


def test_numbered(spark):
    from quillmere.tables import numbered

    rng = np.random.default_rng(1)
    rows = [(None if g == 3 else int(g), i) for i, g in enumerate(rng.choice(4, 400, p=[0.7, 0.1, 0.1, 0.1]))]
    got = {(r.g, r.i): r.number for r in numbered(spark.createDataFrame(rows, "g int, i int").repartition(5), ["g"], ["i"]).collect()}
    for g in (0, 1, 2, None):
        assert [got[g, i] for h, i in rows if h == g] == list(range(sum(h == g for h, _ in rows)))


def test_suppression(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i, float(rng.integers(0, 5)), [float(v) for v in (x, y, x + 4, y + 4)]) for s in range(5) for i in range(12) for x, y in [rng.integers(0, 9, 2)]]
    got = part.suppress_boxes(spark.createDataFrame(rows, "src int, id int, score double, box array<double>"), "src", "score", "box", "id", 0.2, 4).collect()

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        return both / (32 - both)

    for s in range(5):
        kept = []
        for row in sorted((x for x in rows if x[0] == s), key=lambda x: (-x[2], x[1])):
            if len(kept) < 4 and all(iou(row[3], o[3]) <= 0.2 for o in kept):
                kept.append(row)
        assert [x["id"] for x in sorted((x for x in got if x["src"] == s), key=lambda x: x["slot"])] == [x[1] for x in kept]


def test_partners_are_the_most_possible(spark):
    rng = np.random.default_rng(4)
    rows = [(b, b * 10 + i, int(rng.integers(0, 4))) for b in range(6) for i in range(6)]
    near = {0: [1], 1: [0, 2], 2: [3], 3: [3]}
    got = part.match_partners(spark.createDataFrame(rows, "b int, id int, g int"), "b", "id", "g", near).collect()
    group = {i: g for _, i, g in rows}
    for b in range(6):
        mine = [x for x in got if x["batch"] == b]
        ids = sorted(x["id"] for x in mine)
        assert ids == sorted(x["partner"] for x in mine) == [b * 10 + i for i in range(6)]
        assert all(group[x["partner"]] in near[group[x["id"]]] for x in mine if x["guided"])
        best = max(sum(group[q] in near[group[p]] for p, q in zip(ids, order)) for order in itertools.permutations(ids))
        assert sum(x["guided"] for x in mine) == best


def plain_guided(ids, groups, donors, near, key):
    """The same rules by recursion."""
    order = lambda items, k: sorted(items, key=lambda x: hashlib.sha256(f"{k}\0{x}".encode()).hexdigest())
    group, out = dict(zip(ids, groups)), dict(zip(ids, donors))
    guided = order(ids, f"{key}\0guided")[: len(ids) // 2]
    free = [i for i in ids if i not in {out[r] for r in ids if r not in guided}]
    able = {r: order([d for d in free if group[d] in near.get(group[r], [])], f"{key}\0{r}") for r in guided}
    served = {}

    def visit(r, seen):
        for d in able[r]:
            if d not in seen:
                seen.add(d)
                if d not in served or visit(served[d], seen):
                    served[d] = r
                    return True
        return False

    for r in sorted(order(guided, f"{key}\0order"), key=lambda r: len(able[r])):
        visit(r, set())
    new = {r: d for d, r in served.items()}
    rest = zip(order([r for r in guided if r not in new], f"{key}\0receivers"), order([d for d in free if d not in served], f"{key}\0donors"))
    out.update(new | dict(rest))
    return [out[i] for i in ids], [i in guided for i in ids]


def test_guided_partners_like_the_plain_rule(spark):
    rng = np.random.default_rng(9)
    near, rows, want = {0: [1], 1: [0, 2], 2: [3], 3: [3]}, [], {}
    for b in range(25):
        ids = [b * 100 + i for i in range(rng.integers(1, 21))]
        groups, donors = [int(g) for g in rng.integers(0, 5, len(ids))], [int(d) for d in rng.permutation(ids)]
        rows += zip([b] * len(ids), ids, groups, donors)
        partner, guided = plain_guided(ids, groups, donors, near, f"k\0{b}")
        want |= {i: (b, p, g) for i, p, g in zip(ids, partner, guided)}
        assert sorted(partner) == ids and sum(guided) == len(ids) // 2
        assert all(p == d for p, d, g in zip(partner, donors, guided) if not g)
    df = spark.createDataFrame(rows, "b int, id int, g int, p int")
    got = part.guided_partners(df, "b", "id", "g", "p", near, "k").collect()
    assert {r.id: (r.batch, r.partner, r.guided) for r in got} == want
    group = {i: g for _, i, g, _ in rows}
    assert all(r.hit == (group[r.partner] in near.get(group[r.id], [])) for r in got) and sum(r.hit for r in got if r.guided) > 30
    with pytest.raises(Exception, match="no permutation"):
        part.guided_partners(df.where("id % 100 <> 0"), "b", "id", "g", "p", near).collect()
