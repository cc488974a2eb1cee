"""Tails, regressions, spectra and temperatures against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.functions import softlabels as sl
from quillmere.functions import tails
from quillmere.operators import inference as inf


@pytest.mark.parametrize(("n", "p"), [(20, 0.3), (37, 0.5), (5, 0.9), (1, 0.5)])
def test_binomial_tails(n, p):
    mass = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    for k in range(n + 1):
        assert tails.upper_binomial(k, n, p) == pytest.approx(sum(mass[k:]), abs=1e-12)
        assert tails.binomial_two_sided(k, n, p) == pytest.approx(sum(m for m in mass if m <= mass[k] * (1 + 1e-7)), abs=1e-10)


def test_t_tails():
    assert tails.t_critical(4) == pytest.approx(2.7764451, abs=1e-6)
    assert tails.t_tails(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails.t_tails(0.0, 3) == pytest.approx(1.0) and tails.t_tails(math.inf, 3) == 0.0 and math.isnan(tails.t_tails(1.0, 0))


def test_tost_against_simulation():
    x = np.random.default_rng(0).normal(0, 1, (100_000, 20))
    half = tails.t_critical(19, 0.9) * x.std(1, ddof=1) / math.sqrt(20)
    share = ((x.mean(1) + half < 0.7) & (x.mean(1) - half > -0.7)).mean()
    assert tails.tost_power(20, 0.0, 1.0, 0.7) == pytest.approx(share, abs=0.005)
    n = tails.tost_sample_size(0.1, 1.0, 0.5)
    assert tails.tost_power(n, 0.1, 1.0, 0.5) >= 0.8 > tails.tost_power(n - 1, 0.1, 1.0, 0.5)
    with pytest.raises(ValueError):
        tails.tost_sample_size(1.0, 1.0, 0.5)


def test_ols(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = 1.0 + x @ [2.0, -3.0] + rng.normal(size=60)
    rows = [(float(a), float(b), float(c)) for (a, b), c in zip(x, y)]
    got = {r["term"]: r for r in inf.ols(spark.createDataFrame([*rows, (None, 1.0, 1.0)], "a double, b double, y double"), "y", ["a", "b"]).collect()}
    design = np.hstack([np.ones((60, 1)), x])
    beta, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    se = np.sqrt(rss[0] / 57 * np.diag(np.linalg.inv(design.T @ design)))
    for term, b, e in zip(["intercept", "a", "b"], beta, se):
        assert got[term]["estimate"] == pytest.approx(b) and got[term]["se"] == pytest.approx(e) and got[term]["n"] == 60
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, y double")
    assert inf.ols(same, "y", ["a"]).count() == 0  # singular
    assert inf.ols(same.where("y > 9"), "y", ["a"]).count() == 0


def test_spectra(spark):
    x = np.random.default_rng(2).normal(size=(30, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = inf.spectra(spark.createDataFrame([(7, [float(v) for v in row]) for row in x] + [(None, [0.0] * 4)], "g int, v array<double>"), "g", "v").first()
    lam = np.linalg.eigvalsh(x @ x.T / 30)
    lam = lam[lam > 1e-12]
    assert got["n"] == 30 and got["vendi"] == pytest.approx(math.exp(-(lam * np.log(lam)).sum())) and got["participation"] == pytest.approx(1 / (lam @ lam))
    spread = np.linalg.eigvalsh(np.cov(x.T))
    assert got["first_share"] == pytest.approx(spread[-1] / spread.sum())


def test_match_entropy(spark):
    z = spark.createDataFrame([([1.0, 2.0, 4.0],), ([0.0, 0.5, 0.1],)], "z array<double>")
    t = inf.match_entropy(z, "z", 0.8)
    mean = lambda t: np.mean([-(q * np.log(q)).sum() for q in (np.exp(np.array(v) / t) / np.exp(np.array(v) / t).sum() for v in ([1.0, 2.0, 4.0], [0.0, 0.5, 0.1]))])
    assert mean(t) == pytest.approx(0.8, abs=1e-6)
    with pytest.raises(ValueError):
        inf.match_entropy(z.where("false"), "z", 0.8)


def test_mixed_model_without_group_variance(spark):
    rows = [(g, v) for g in range(3) for v in (1.0, 2.0, 6.0)]
    m = inf.mixed_model(spark.createDataFrame(rows, "g int, v double"), "g", "v").first()
    pooled = np.var([v for _, v in rows], ddof=1)
    assert m["var_between"] == 0.0 and m["df"] == 8.0 and m["se"] == pytest.approx(math.sqrt(pooled / 9)) and m["naive_t"] == pytest.approx(m["t"])


def test_derangement_moves_every_other_class(spark):
    d = spark.range(50).select((F.col("id") % 10).cast("int").alias("t"), sl.derangement(F.col("id"), 3, (F.col("id") % 10).cast("int"), 10).alias("to")).collect()
    for row in d:
        assert sorted(row["to"]) == list(range(10)) and row["to"][row["t"]] == row["t"]
        assert all(k != v for k, v in enumerate(row["to"]) if k != row["t"])


def test_allocate(spark):
    rows = [([1.0, 2.0, 7.0, 0.0], 4.0), ([1.0, 1.0, 1.0, 1.0], 8.0), ([5.0, 1.0, 1.0, 1.0], 9.0), ([0.0, 0.0, 0.0, 1.0], 4.0)]
    got = [r["a"] for r in spark.createDataFrame(rows, "w array<double>, t double").select(sl.allocate(F.col("w"), F.col("t"), 0.5, 2.0).alias("a")).collect()]
    for (w, t), a in zip(rows[:2], got):
        assert sum(a) == pytest.approx(t) and min(a) >= 0.5 and max(a) <= 2.0
        free = [x / v for x, v in zip(a, w) if 0.5 + 1e-9 < x < 2.0 - 1e-9]
        assert not free or max(free) == pytest.approx(min(free))  # one scale for all that no bound holds
    assert got[2] is None  # nine do not fit under four caps of two
    assert got[3] is None or sum(got[3]) == pytest.approx(4.0)


def test_interpolate_ends(spark):
    d = spark.createDataFrame([(-1.0,), (0.0,), (5.0,), (10.0,), (99.0,)], "x double")
    got = [r["y"] for r in d.select(sl.interpolate(F.lit([0.0, 10.0]), F.lit([1.0, 3.0]), F.col("x")).alias("y")).collect()]
    assert got == pytest.approx([1.0, 1.0, 2.0, 3.0, 3.0])


def plain_reml(groups, levels, y):
    """Whole matrices: the likelihood searched by golden section over the ratio, Satterthwaite by differences of both variances."""
    y, n, names = np.asarray(y), len(y), sorted(set(levels))
    p = len(names)
    code = np.hstack([np.ones((p, 1)), np.vstack([np.eye(p - 1), -np.ones((1, p - 1))])]) if p > 1 else np.ones((1, 1))
    x = code[[names.index(v) for v in levels]]
    same = np.equal.outer(groups, groups).astype(float)

    def minus_two(between, within):
        v = np.linalg.inv(within * np.eye(n) + between * same)
        a = x.T @ v @ x
        b = np.linalg.solve(a, x.T @ v @ y)
        return -np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + (y - x @ b) @ v @ (y - x @ b), b, np.linalg.inv(a)[0, 0]

    def profile(w):
        v = np.linalg.inv(np.eye(n) + math.exp(w) * same)
        a = x.T @ v @ x
        b = np.linalg.solve(a, x.T @ v @ y)
        s = (y - x @ b) @ v @ (y - x @ b) / (n - p)
        return -np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + (n - p) * math.log(s), s

    low, high = min(((w - 1, w + 1) for w in np.linspace(-10, 10, 41)), key=lambda b: profile(sum(b) / 2)[0])
    for _ in range(120):
        a, b = high - (high - low) * 0.618, low + (high - low) * 0.618
        low, high = (low, b) if profile(a)[0] < profile(b)[0] else (a, high)
    within = profile(low)[1]
    at = np.array([math.exp(low) * within, within])
    h = at * 1e-3
    f = lambda i, j: minus_two(*(at + h * [i, j]))[0]
    cross = (f(1, 1) - f(1, -1) - f(-1, 1) + f(-1, -1)) / (4 * h[0] * h[1])
    hessian = np.array([[(f(1, 0) - 2 * f(0, 0) + f(-1, 0)) / h[0] ** 2, cross], [cross, (f(0, 1) - 2 * f(0, 0) + f(0, -1)) / h[1] ** 2]])
    var = lambda i, j: minus_two(*(at + h * [i, j]))[2]
    slope = np.array([(var(1, 0) - var(-1, 0)) / (2 * h[0]), (var(0, 1) - var(0, -1)) / (2 * h[1])])
    _, b, v = minus_two(*at)
    return b[0], math.sqrt(v), 2 * v**2 / (slope @ (2 * np.linalg.inv(hessian)) @ slope), at[0], at[1]


@pytest.mark.parametrize(("fixed", "seed"), [(False, 0), (True, 1), (True, 2)])
def test_mixed_model_of_unequal_groups(spark, fixed, seed):
    rng = np.random.default_rng(seed)
    rows = [(g, f"s{j}", float(5_000 + e + 2.0 * j + rng.normal())) for g, e in enumerate(rng.normal(scale=2, size=9)) for j in range(3) for _ in range(rng.integers(0, 5) + (g == 0))]
    df = spark.createDataFrame([*rows, (None, "s0", 1.0), (1, "s1", None)], "g int, s string, v double")
    m = inf.mixed_model(df, "g", "v", "s" if fixed else None).first()
    mean, se, degrees, between, within = plain_reml([r[0] for r in rows], [r[1] if fixed else "" for r in rows], [r[2] for r in rows])
    assert m["mean"] == pytest.approx(mean, rel=1e-7) and m["se"] == pytest.approx(se, rel=1e-5) and m["df"] == pytest.approx(degrees, rel=2e-3)
    assert m["var_between"] == pytest.approx(between, rel=1e-4) and m["var_within"] == pytest.approx(within, rel=1e-5)
    assert m["p"] == pytest.approx(2 * (1 - _t_cdf(abs(m["t"]), m["df"])), abs=1e-3)


def _t_cdf(t, df):
    x = np.linspace(-400, t, 2_000_001)
    y = (1 + x * x / df) ** (-(df + 1) / 2)
    full = np.linspace(-400, 400, 4_000_001)
    return np.trapezoid(y, x) / np.trapezoid((1 + full * full / df) ** (-(df + 1) / 2), full)


def test_iterated_model_has_the_closed_form(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(e + rng.normal())) for g, e in enumerate(rng.normal(scale=3, size=6)) for _ in range(5)]
    df = spark.createDataFrame(rows, "g int, v double")
    a, b = inf.mixed_model(df, "g", "v").first(), inf._reml(df, "g", "v", None).first()
    for c in ("mean", "se", "t", "var_between", "var_within", "naive_t"):
        assert a[c] == pytest.approx(b[c], rel=1e-5), c
    assert b["df"] == pytest.approx(5, rel=1e-4) and a["p"] == pytest.approx(b["p"], rel=1e-3)


def test_iterated_model_without_group_variance(spark):
    rows = [(g, x) for g in range(4) for x in ([-1.0, 1.0, 0.5] if g else [-1.0, 1.0])]
    m = inf.mixed_model(spark.createDataFrame(rows, "g int, v double"), "g", "v").first()
    x = np.array([r[1] for r in rows])
    assert m["var_between"] == 0 and m["df"] == len(x) - 1 and m["se"] == pytest.approx(x.std(ddof=1) / math.sqrt(len(x)))


def test_fitted_temperature_is_the_least(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(300, 5)) * 4
    target = [int(t) for t in np.where(rng.random(300) < 0.6, z.argmax(axis=1), rng.integers(0, 5, 300))]
    rows = [(i % 4 * 10, t, [float(v) for v in row]) for i, (t, row) in enumerate(zip(target, z))]
    got = inf.fitted_temperature(spark.createDataFrame(rows, "f int, t int, z array<double>"), "z", "t", "f").collect()
    fold, target = np.array([r[0] for r in rows]), np.array(target)

    def loss(x, some):
        s = z[some] / math.exp(x)
        top = s.max(axis=1)
        return np.mean(np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[np.arange(some.sum()), target[some]])

    for r in got:
        grid = np.linspace(-6, 6, 2_001)
        for _ in range(3):
            at = grid[np.argmin([loss(x, fold != r["fold"]) for x in grid])]
            grid = np.linspace(at - (grid[1] - grid[0]), at + (grid[1] - grid[0]), 201)
        assert math.log(r["temperature"]) == pytest.approx(at, abs=1e-6) and r["loss"] == pytest.approx(loss(at, fold == r["fold"]), abs=1e-6) and not r["at_bound"]
    sure = spark.createDataFrame([(f, 0, [1.0, 0.0]) for f in (0, 1)], "f int, t int, z array<double>")
    assert all(r["temperature"] < 0.05 and r["loss"] < 1e-12 for r in inf.fitted_temperature(sure, "z", "t", "f").collect())  # flat there
    wrong = spark.createDataFrame([(f, 1, [1.0, 0.0]) for f in (0, 1)], "f int, t int, z array<double>")
    assert all(r["at_bound"] and r["temperature"] > 400 for r in inf.fitted_temperature(wrong, "z", "t", "f").collect())
