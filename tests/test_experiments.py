"""Existence within a distance, caliper pairs, interleaving and permutations against all pairs and all permutations."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from quillmere import operators as op


@pytest.mark.parametrize("bits, most", [(56, 12), (64, 3), (20, 0), (63, 6)])
def test_hamming_exists_and_links(spark, bits, most):
    rng = random.Random(bits)
    codes = []
    for k in range(120):
        c = rng.getrandbits(bits) if k % 3 == 0 or not codes else rng.choice(codes)
        for _ in range(rng.randrange(0, most + 3)):
            c ^= 1 << rng.randrange(bits)
        codes.append(c)
    signed = [c - (1 << 64) if c >= 1 << 63 else c for c in codes]
    rows = [(k, k % 2, c) for k, c in enumerate(signed)]
    df = spark.createDataFrame(rows, "id long, label int, code long")
    apart = lambda a, b: bin(codes[a] ^ codes[b]).count("1")
    got = {r.id: r.near for r in op.hamming_exists(df.where("id < 60"), df.where("id >= 60"), "label", "code", most, bits).collect()}
    assert got == {k: any(apart(k, j) <= most for j in range(60, 120) if j % 2 == k % 2) for k in range(60)}
    links = {r.id: (r.class_id, r.links) for r in op.hamming_links(df, "id", "label", "code", most, bits).collect()}
    for k in range(120):
        same = [j for j in range(120) if j % 2 == k % 2]
        assert links[k] == (min(j for j in same if codes[j] == codes[k]), sum(apart(k, j) <= most for j in same if j != k))


def test_caliper_pairs(spark):
    rng = random.Random(1)
    rows = [(k, k % 3, rng.choice([0.0, 5.0, -7.5, rng.uniform(-30, 30)])) for k in range(90)] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "id long, s int, x double")
    got = sorted((r.id, r.other) for r in op.caliper_pairs(df, "s", "x", "id", 5.0).collect())
    assert got == sorted((a[0], b[0]) for a, b in itertools.combinations(rows[:90], 2) if a[1] == b[1] and abs(a[2] - b[2]) <= 5.0)


def test_interleaved(spark):
    rows = [("b", k) for k in (5, 1, 9)] + [("a", 7)] + [("c", k) for k in (2, 3, 4, 8)]
    got = [(r.g, r.k) for r in sorted(op.interleaved(spark.createDataFrame(rows, "g string, k int"), "g", "k").collect(), key=lambda r: r.place)]
    assert got == [("a", 7), ("b", 1), ("c", 2), ("b", 5), ("c", 3), ("b", 9), ("c", 4), ("c", 8)]


def test_most_disorder_against_all_permutations(spark):
    rng = random.Random(2)
    sigmas = [rng.sample(range(n), n) for n in (1, 2, 3, 4, 5, 6, 6, 6, 6)]
    df = spark.createDataFrame([*enumerate(sigmas)], "id long, sigma array<int>")
    got = {r.id: r for r in op.most_disorder(df, "id", "sigma").collect()}
    for k, s in enumerate(sigmas):
        n = len(s)
        pairs = Counter(frozenset((a, b)) for a, b in enumerate(s))
        able = {tuple(rho[x] for x in s) for rho in itertools.permutations(range(n)) if Counter(frozenset((a, b)) for a, b in enumerate(rho)) == pairs}
        rho = lambda p: 1 - 6 * sum((a - b) ** 2 for a, b in enumerate(p)) / (n * (n * n - 1)) if n > 1 else 0.0
        assert got[k].candidates == len(able)
        if n > 1:
            best = min(able, key=lambda p: (rho(p), p))
            assert tuple(got[k].farthest) == best and abs(got[k].rho - rho(best)) < 1e-12


def test_forward_and_backward_as_of(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "a", 9), (4, "b", 1)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 6, "y"), ("c", 1, "z")], "k string, t int, v string")
    back = {r.id: r.v for r in op.as_of(left, right, "k", "t", "v").collect()}
    ahead = {r.id: r.v for r in op.as_of(left, right, "k", "t", "v", forward=True).collect()}
    assert back == {1: "x", 2: "x", 3: "y", 4: None} and ahead == {1: "y", 2: "x", 3: None, 4: None}


def test_as_of_in_slices(spark):
    """Slices of any width give what one sort a key gives, null keys and null values among the rows."""
    rng = random.Random(8)
    left = spark.createDataFrame([(k, rng.choice(["a", "b", None]), rng.randrange(200)) for k in range(80)], "id int, k string, t int")
    right = spark.createDataFrame([(k, t, rng.choice([None, f"{k}{t}"])) for k, t in {(rng.choice(["a", "b", None]), rng.randrange(200)) for _ in range(60)}], "k string, t int, v string")
    for forward in (False, True):
        whole = {r.id: r.v for r in op.as_of(left, right, "k", "t", "v", forward).collect()}
        for width in (7, 50, 1000):
            assert {r.id: r.v for r in op.as_of(left, right, "k", "t", "v", forward, width).collect()} == whole


def test_tree_digest(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [("a", k, f"text {k}") for k in (3, 1, 25, 12, 11)] + [("b", 7, "x"), ("b", 8, None)]
    got = dict(tuple(r) for r in op.tree_digest(spark.createDataFrame(rows, "g string, k long, t string"), "g", "k", "t", 10).collect())
    parts = [sha("\n".join(f"{k}:{sha(f'text {k}')}" for k in own)) for own in ((1, 3), (11, 12), (25,))]
    assert got == {"a": sha("\n".join(parts)), "b": sha(sha(f"7:{sha('x')}"))}


def test_both_ways_of_margins_agree(spark, monkeypatch):
    rng = random.Random(3)
    unit = spark.createDataFrame([(k, k % 4, [rng.gauss(0, 1) for _ in range(5)]) for k in range(40)], "vec_id long, label int, unit array<double>")
    protos = op.prototypes(unit)
    one = sorted(op.margins(unit, protos).collect())
    monkeypatch.setattr(op, "FEW_PROTOTYPES", 0)
    two = sorted(op.margins(unit, protos).collect())
    assert [r.rival_label for r in one] == [r.rival_label for r in two] and all(abs(a.margin - b.margin) < 1e-12 for a, b in zip(one, two, strict=True))


def unit_rows(n, dim, labels, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 3 * np.eye(dim)[rng.integers(0, 3, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(k, k % labels, [float(v) for v in x[k]]) for k in range(n)]


@pytest.mark.parametrize("block", [2048, 16])
def test_facility_over_all_vectors(spark, block):
    """Every choice against the best of all candidates, in one tile a label and in many."""
    import numpy as np

    rows = unit_rows(90, 4, 2, 1)
    got = op.greedy_facility(spark.createDataFrame(rows, "vec_id long, label int, unit array<double>"), 4, block).collect()
    for label in (0, 1):
        ids = [r[0] for r in rows if r[1] == label]
        x = np.array([r[2] for r in rows if r[1] == label])
        near, taken = np.full(len(x), -1.0), []
        for r in sorted((r for r in got if r.label == label), key=lambda r: r.slot):
            utility = np.round(np.maximum(near[:, None], x @ x.T).mean(axis=0), 12)
            utility[taken] = -1
            best = int(utility.argmax())
            assert r.vec_id == ids[best] and abs(r.utility - utility[best]) < 1e-9
            taken.append(best)
            near = np.maximum(near, x @ x[best])
        assert len(taken) == 4


def test_kmeans_steps_run_over_all_vectors(spark):
    """With a small sample to begin from, the end is a fixed point of Lloyd's step over all vectors."""
    import numpy as np

    rows = unit_rows(400, 5, 2, 2)
    df = spark.createDataFrame(rows, "vec_id long, label int, unit array<double>").repartition(5)
    own = {r.vec_id: r.cluster for r in op.spherical_kmeans(df, 3, most=20, rounds=60).collect()}
    assert len(own) == 400
    for label in (0, 1):
        x = np.array([r[2] for r in rows if r[1] == label])
        c = np.array([own[r[0]] for r in rows if r[1] == label])
        centres = np.array([x[c == j].sum(axis=0) for j in range(3)])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        assert ((x @ centres.T).argmax(axis=1) == c).all()
    assert op.spherical_kmeans(df.limit(0), 3).count() == 0 and op.greedy_facility(df.limit(0), 3).count() == 0


def test_discrepancy_with_a_frequent_vector(spark):
    import numpy as np

    from quillmere.operators.inference import kernel_discrepancy

    rng = np.random.default_rng(4)
    rows = [(bool(k % 2), [1.0, 2.0, 3.0]) for k in range(60)] + [(bool(k % 3), [float(v) for v in rng.normal(size=3)]) for k in range(50)]
    got = kernel_discrepancy(spark.createDataFrame(rows, "side boolean, v array<double>"), "side", "v", sigma=2.0, scale=1.0, block=16).first()[0]
    a, b = (np.array([v for s, v in rows if s == side]) for side in (True, False))
    k = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(axis=2) / 8.0)
    m, n = len(a), len(b)
    want = (k(a, a).sum() - m) / (m * (m - 1)) + (k(b, b).sum() - n) / (n * (n - 1)) - 2 * k(a, b).mean()
    assert abs(got - want) < 1e-9


def test_joint_choice_is_a_fixed_point(spark):
    """One of each source; no exchange of one of them does better; the greedy part starts as the best single vector would."""
    import numpy as np

    rows = [(k, label, u, (k // 2) % 3) for k, label, u in unit_rows(60, 4, 2, 5)]
    got = op.joint_facility(spark.createDataFrame(rows, "vec_id long, label int, unit array<double>, source int"), "source", block=16).collect()
    for label in (0, 1):
        own = {r.source: r.vec_id for r in got if r.label == label}
        assert sorted(own) == [0, 1, 2]
        x = {k: np.array(u) for k, g, u, _ in rows if g == label}
        every = np.array(list(x.values()))
        utility = lambda ids: (every @ np.array([x[i] for i in ids]).T).max(axis=1).mean()
        now = utility(own.values())
        assert all(abs(r.utility - now) < 1e-9 for r in got if r.label == label)
        for s in own:
            for k, g, _, source in rows:
                if g == label and source == s:
                    assert utility([*(v for t, v in own.items() if t != s), k]) <= now + 1e-9


def test_two_means(spark):
    import numpy as np

    rows = unit_rows(80, 4, 2, 7)
    df = spark.createDataFrame(rows, "vec_id long, label int, unit array<double>")
    got = op.two_means(df, 11).collect()
    assert sorted(got) == sorted(op.two_means(df.repartition(5), 11).collect())  # the order of rows does not matter
    for label in (0, 1):
        ids = [r[0] for r in rows if r[1] == label]
        x = np.array([r[2] for r in rows if r[1] == label])
        mine = sorted((r.cluster, r.vec_id, r.size) for r in got if r.label == label)
        assert [c for c, _, _ in mine] == [0, 1] and mine[0][1] < mine[1][1] and sum(n for _, _, n in mine) == len(ids)
        # from the representatives' clusters Lloyd's step changes nothing: found by running it from the representatives themselves
        best = None
        for a in range(len(x)):
            for b in range(a + 1, len(x)):
                c = x[[a, b]]
                for _ in range(40):
                    own = (x @ c.T).argmax(axis=1)
                    if len(set(own.tolist())) < 2:
                        break
                    c = np.array([x[own == j].sum(axis=0) for j in (0, 1)])
                    c /= np.linalg.norm(c, axis=1, keepdims=True)
                near = tuple(sorted(ids[int(np.where(own == j, x @ c[j], -2).argmax())] for j in (0, 1)))
                best = (best or set()) | {near}
        assert tuple(v for _, v, _ in mine) in best
    assert op.two_means(df.limit(0), 1).count() == 0


def test_places_of_columns():
    import numpy as np

    from quillmere.operators.partition import balance, capacities

    rng = np.random.default_rng(3)
    for n in (3, 5, 6, 7):
        sim = rng.normal(size=(n, 3))
        places = capacities(sim)
        assert places.sum() == n and places.max() - places.min() <= 1
        got = balance(sim, places)
        assert np.bincount(got, minlength=3).tolist() == places.tolist()
        best = max(sum(sim[k, c] for k, c in enumerate(own)) for own in itertools.product(range(3), repeat=n) if np.bincount(own, minlength=3).tolist() == places.tolist())
        assert abs(sim[np.arange(n), got].sum() - best) < 1e-9


def test_disorder_of_many_cycles(spark):
    """Ninety-nine places in cycles of three: two ways each, found without trying them all."""
    sigma = [k - k % 3 + (k + 1) % 3 for k in range(99)]
    r = op.most_disorder(spark.createDataFrame([(1, sigma)], "id int, sigma array<int>"), "id", "sigma").first()
    assert r.candidates == 2**33 and list(r.farthest) == [sigma[k] for k in sigma]


@pytest.mark.parametrize("tried", [1, 4, 1_000])
def test_facility_by_bounds_is_the_plain_choice(spark, monkeypatch, tried):
    """Many slots, copies among the vectors, and bounds that leave most candidates untried."""
    rng = np.random.default_rng(8)
    rows = []
    for label, n in ((0, 120), (1, 7), (2, 1)):
        x = rng.normal(size=(n, 4))
        x[: n // 6] = x[0]
        rows += [(label * 1000 + i, label, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist())]
    monkeypatch.setattr(op, "TRIED", tried)
    tries = []
    sums = op._facility_sums
    monkeypatch.setattr(op, "_facility_sums", lambda v, h, a: tries.append(sum(map(len, a.values()))) or sums(v, h, a))
    got = op.greedy_facility(spark.createDataFrame(rows, "vec_id long, label int, unit array<double>"), 9, 50).collect()
    for label in range(3):
        ids, x = zip(*((i, v) for i, l, v in rows if l == label))
        sim, near, want = np.array(x) @ np.array(x).T, np.full(len(x), -1.0), []
        for _ in range(min(9, len(x))):
            total = np.maximum(near[:, None], sim).sum(axis=0)
            best = min((round(-total[c] / len(x), 10), i, c) for c, i in enumerate(ids) if i not in want)
            want.append(best[1])
            near = np.maximum(near, sim[:, best[2]])
        assert [r.vec_id for r in sorted((r for r in got if r.label == label), key=lambda r: r.slot)] == want
    if tried < 10:
        assert sum(tries) < 0.6 * 7 * 128
