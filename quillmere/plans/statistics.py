"""Group summaries, factorial experiments and their inference on the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import operators as op
from .. import functions as fn
from .registry import query, r

_CELL = "SELECT l_returnflag AS arm, l_linestatus AS stat, CAST(year(l_shipdate) AS INT) AS seed, l_extendedprice AS v FROM lineitem"


def _cells(table):
    """Line items as runs: an arm, a status and a year for a seed."""
    return table("lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("stat"), F.year("l_shipdate").alias("seed"), F.col("l_extendedprice").alias("v"))


@query("q_group_summary", f"SELECT arm, count(v) AS n, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS sd, min(v) AS least, max(v) AS largest FROM ({_CELL}) GROUP BY arm")
def q_group_summary(table):
    """Count, mean, sample deviation and range of each group (A1)."""
    g = _cells(table).groupBy("arm").agg(*op.sample_stats("v"))
    return g.withColumns({"mean": F.round("mean", 3), "sd": F.round("sd", 3)})


@query("q_target_stats", f"SELECT arm, round(avg(v) - 50000, 3) AS gap, round(min(abs(v - 50000)), 3) AS closest, min(v) <= 50000 AND max(v) >= 50000 AS within FROM ({_CELL}) GROUP BY arm")
def q_target_stats(table):
    """Distance to a published target (A3)."""
    return _cells(table).groupBy("arm").agg(F.round(F.avg("v") - 50000, 3).alias("gap"), F.round(F.min(F.abs(F.col("v") - 50000)), 3).alias("closest"), ((F.min("v") <= 50000) & (F.max("v") >= 50000)).alias("within"))


@query("q_sign_counts", "SELECT c_mktsegment, count(*) FILTER (c_acctbal > 1) AS positive, count(*) FILTER (c_acctbal < -1) AS negative, count(*) FILTER (abs(c_acctbal) <= 1) AS ties FROM customer GROUP BY 1")
def q_sign_counts(table):
    """Signs beyond an epsilon."""
    s = table("customer").select("c_mktsegment", fn.sign_class(F.col("c_acctbal"), 1.0).alias("s"))
    return s.groupBy("c_mktsegment").agg(F.count_if(F.col("s") == "+").alias("positive"), F.count_if(F.col("s") == "-").alias("negative"), F.count_if(F.col("s") == "tie").alias("ties"))


@query("q_distribution", "SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 3) AS mean, round(quantile_cont(o_totalprice, 0.05), 4) AS p05, round(median(o_totalprice), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY 1")
def q_distribution(table):
    """Exact quantiles."""
    g = table("orders").groupBy("o_orderpriority").agg(*op.distribution("o_totalprice", (0.05, 0.5, 0.95)))
    return g.select("o_orderpriority", "n", F.round("mean", 3).alias("mean"), *(F.round(c, 4).alias(c) for c in ("p05", "p50", "p95")))


@query("q_hierarchical_sd2", f"WITH c AS (SELECT arm, seed, avg(v) AS cell FROM ({_CELL}) GROUP BY 1, 2), l AS (SELECT arm, avg(cell) AS m, var_samp(cell) AS s FROM c GROUP BY arm) SELECT round(avg(m), 3) AS grand_mean, round(sqrt(avg(s)), 3) AS sd_within, round(stddev_samp(m), 3) AS sd_between, count(*) AS levels FROM l")
def q_hierarchical_sd2(table):
    """Deviation within and between levels."""
    d = op.two_level(_cells(table), "v", "arm", "seed")
    return d.select(*(F.round(c, 3).alias(c) for c in ("grand_mean", "sd_within", "sd_between")), "levels")


@query("q_hierarchical_sd3", f"WITH c AS (SELECT arm, stat, seed, avg(v) AS x FROM ({_CELL}) GROUP BY ALL), b AS (SELECT arm, stat, avg(x) AS m, var_samp(x) AS s FROM c GROUP BY ALL), a AS (SELECT arm, avg(m) AS m, var_samp(m) AS s2, avg(s) AS s3 FROM b GROUP BY arm) SELECT round(avg(m), 3) AS grand_mean, round(stddev_samp(m), 3) AS sd1, round(sqrt(avg(s2)), 3) AS sd2, round(sqrt(avg(s3)), 3) AS sd3 FROM a")
def q_hierarchical_sd3(table):
    """Three levels (A10)."""
    c = _cells(table).groupBy("arm", "stat", "seed").agg(F.avg("v").alias("x"))
    b = c.groupBy("arm", "stat").agg(F.avg("x").alias("m"), F.var_samp("x").alias("s"))
    a = b.groupBy("arm").agg(F.avg("m").alias("m"), F.var_samp("m").alias("s2"), F.avg("s").alias("s3"))
    return a.agg(F.round(F.avg("m"), 3).alias("grand_mean"), F.round(F.stddev_samp("m"), 3).alias("sd1"), F.round(F.sqrt(F.avg("s2")), 3).alias("sd2"), F.round(F.sqrt(F.avg("s3")), 3).alias("sd3"))


@query("q_factorial_cube", f"SELECT arm, stat, count(*) AS n, round(avg(v), 3) AS mean FROM ({_CELL}) GROUP BY CUBE (arm, stat)")
def q_factorial_cube(table):
    """Cell means, marginals and the grand mean."""
    return _cells(table).cube("arm", "stat").agg(F.count("*").alias("n"), F.round(F.avg("v"), 3).alias("mean"))


@query("q_additive_residual", f"WITH c AS (SELECT arm, seed, avg(v) AS x FROM ({_CELL}) GROUP BY 1, 2) SELECT arm, seed, round(x - avg(x) OVER (PARTITION BY arm) - avg(x) OVER (PARTITION BY seed) + avg(x) OVER (), 3) + 0.0 AS residual FROM c")
def q_additive_residual(table):
    """Cell less row and column mean plus the grand mean."""
    c = _cells(table).groupBy("arm", "seed").agg(F.avg("v").alias("x"))
    mean = lambda *by: F.avg("x").over(Window.partitionBy(*by))
    grand = c.agg(F.avg("x").alias("g"))
    return c.join(grand).select("arm", "seed", r(F.col("x") - mean("arm") - mean("seed") + F.col("g"), 3).alias("residual"))


@query("q_did", f"SELECT seed, round((avg(v) FILTER (arm = 'A' AND stat = 'F') - avg(v) FILTER (arm = 'N' AND stat = 'F')) - (avg(v) FILTER (arm = 'A' AND stat = 'O') - avg(v) FILTER (arm = 'N' AND stat = 'O')), 3) + 0.0 AS did FROM ({_CELL}) GROUP BY seed")
def q_did(table):
    """Difference in differences of each seed."""
    m = lambda a, s: F.avg(F.when((F.col("arm") == a) & (F.col("stat") == s), F.col("v")))
    return _cells(table).groupBy("seed").agg(r((m("A", "F") - m("N", "F")) - (m("A", "O") - m("N", "O")), 3).alias("did"))


@query("q_paired_gain", f"WITH c AS (SELECT arm, seed, avg(v) AS x FROM ({_CELL}) GROUP BY 1, 2), p AS (SELECT a.seed, a.x - b.x AS g FROM c a JOIN c b ON a.seed = b.seed WHERE a.arm = 'A' AND b.arm = 'R') SELECT count(*) AS n, round(avg(g), 3) + 0.0 AS mean, round(stddev_samp(g) / sqrt(count(*)), 3) AS se, round(avg(g) / (stddev_samp(g) / sqrt(count(*))), 4) + 0.0 AS t FROM p")
def q_paired_gain(table):
    """Paired gains over seeds with their t."""
    c = _cells(table).groupBy("seed").pivot("arm", ["A", "R"]).agg(F.avg("v"))
    g = c.select((F.col("A") - F.col("R")).alias("g")).where("g is not null")
    se = F.stddev_samp("g") / F.sqrt(F.count("*").cast("double"))
    return g.agg(F.count("*").alias("n"), r(F.avg("g"), 3).alias("mean"), F.round(se, 3).alias("se"), r(F.avg("g") / se, 4).alias("t"))


@query("q_two_way_variance", f"WITH c AS (SELECT arm, seed, avg(v) AS x FROM ({_CELL}) GROUP BY 1, 2), m AS (SELECT *, avg(x) OVER (PARTITION BY arm) AS ra, avg(x) OVER (PARTITION BY seed) AS cs, avg(x) OVER () AS g FROM c), k AS (SELECT count(DISTINCT arm) AS a, count(DISTINCT seed) AS b FROM c) SELECT round(sum((ra - g) * (ra - g)) / (a - 1), 2) AS ms_arm, round(sum((cs - g) * (cs - g)) / (b - 1), 2) AS ms_seed, round(sum((x - ra - cs + g) * (x - ra - cs + g)) / ((a - 1) * (b - 1)), 2) AS ms_error FROM m, k GROUP BY a, b")
def q_two_way_variance(table):
    """Mean squares of a crossed design."""
    c = _cells(table).groupBy("arm", "seed").agg(F.avg("v").alias("x"))
    mean = lambda *by: F.avg("x").over(Window.partitionBy(*by))
    sizes = c.agg(F.avg("x").alias("g"), F.count_distinct("arm").alias("a"), F.count_distinct("seed").alias("b"))
    m = c.withColumns({"ra": mean("arm"), "cs": mean("seed")}).join(sizes)
    sq = lambda e: F.sum(e * e)
    x, ra, cs, g = (F.col(k) for k in ("x", "ra", "cs", "g"))
    return m.groupBy("a", "b").agg(sq(ra - g).alias("s1"), sq(cs - g).alias("s2"), sq(x - ra - cs + g).alias("s3")).select(F.round(F.col("s1") / (F.col("a") - 1), 2).alias("ms_arm"), F.round(F.col("s2") / (F.col("b") - 1), 2).alias("ms_seed"), F.round(F.col("s3") / ((F.col("a") - 1) * (F.col("b") - 1)), 2).alias("ms_error"))


@query("q_ols", "SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2 FROM part")
def q_ols(table):
    """A line fit in one aggregation (M4, M7)."""
    return table("part").agg(F.round(F.regr_slope("p_retailprice", "p_size"), 6).alias("slope"), F.round(F.regr_intercept("p_retailprice", "p_size"), 4).alias("intercept"), F.round(F.regr_r2("p_retailprice", "p_size"), 6).alias("r2"))


@query("q_pearson", "SELECT l_returnflag, round(covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0), 6) AS r FROM lineitem GROUP BY 1")
def q_pearson(table):
    """Correlation, null where a side does not vary (M1)."""
    return table("lineitem").groupBy("l_returnflag").agg(F.round(fn.correlation(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))


@query("q_spearman", "WITH k AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lang ORDER BY doc_id) * 1.0 AS b FROM documents) SELECT lang, round(corr(a, b), 6) + 0.0 AS rho FROM k GROUP BY lang")
def q_spearman(table):
    """Pearson of average ranks."""
    k = table("documents").select("lang", op.average_rank("n_chars", "lang").alias("a"), op.average_rank("doc_id", "lang").alias("b"))
    return k.groupBy("lang").agg(r(fn.correlation(F.col("a"), F.col("b"))).alias("rho"))


@query("q_residual_corr", "WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s1, regr_intercept(l_extendedprice, l_quantity) AS i1, regr_slope(l_tax, l_quantity) AS s2, regr_intercept(l_tax, l_quantity) AS i2 FROM lineitem) SELECT round(corr(l_extendedprice - s1 * l_quantity - i1, l_tax - s2 * l_quantity - i2), 6) + 0.0 AS r FROM lineitem, f")
def q_residual_corr(table):
    """Partial correlation from one pass of second moments (M5)."""
    c = {f"{a}{b}": F.covar_pop(x, y) for a, x, b, y in (("p", "l_extendedprice", "t", "l_tax"), ("p", "l_extendedprice", "q", "l_quantity"), ("t", "l_tax", "q", "l_quantity"))}
    d = table("lineitem").agg(*(v.alias(k) for k, v in c.items()), F.var_pop("l_extendedprice").alias("vp"), F.var_pop("l_tax").alias("vt"), F.var_pop("l_quantity").alias("vq"))
    return d.selectExpr("round((pt - pq * tq / vq) / sqrt((vp - pq * pq / vq) * (vt - tq * tq / vq)), 6) + 0.0d as r")


@query("q_histogram", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def q_histogram(table):
    """The ten most common values (A14): a top-k report."""
    return table("documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("q_partial_moments", f"WITH g AS (SELECT arm, seed, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM ({_CELL}) GROUP BY 1, 2) SELECT arm, round(sum(s) / sum(n), 3) AS item_mean, round(avg(s / n), 3) AS group_mean, round(sqrt(sum(q) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n))), 2) AS sd FROM g GROUP BY arm")
def q_partial_moments(table):
    """Mergeable moments; means by item and by group."""
    g = _cells(table).groupBy("arm", "seed").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    mean = F.sum("s") / F.sum("n")
    return g.groupBy("arm").agg(F.round(mean, 3).alias("item_mean"), F.round(F.avg(F.col("s") / F.col("n")), 3).alias("group_mean"), F.round(F.sqrt(F.sum("q") / F.sum("n") - mean * mean), 2).alias("sd"))


@query("q_fixed_bins", "WITH b AS (SELECT label, least(CAST(floor((embedding[1] + 1) / 2 * 20) AS INT) + 1, 20) AS bin FROM embeddings) SELECT label, bin, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY label) AS DOUBLE), 6) AS share FROM b GROUP BY label, bin")
def q_fixed_bins(table):
    """Twenty bins on [0, 1], the last one closed, as shares of each label."""
    x = (F.col("embedding")[0].cast("double") + 1) / 2
    b = table("embeddings").select("label", F.least(F.floor(x * 20).cast("int") + 1, F.lit(20)).alias("bin")).groupBy("label", "bin").agg(F.count("*").alias("n"))
    return b.select("label", "bin", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")).cast("double"), 6).alias("share"))


@query("q_complement_mean", f"WITH a AS (SELECT arm, sum(v) AS s, count(*) AS n FROM ({_CELL}) GROUP BY arm) SELECT arm, round(((SELECT sum(s) FROM a) - s) / ((SELECT sum(n) FROM a) - n), 3) AS rest FROM a")
def q_complement_mean(table):
    """The mean of all others."""
    a = _cells(table).groupBy("arm").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    whole = a.agg(F.sum("s").alias("ss"), F.sum("n").alias("nn"))
    return a.join(whole).select("arm", F.round((F.col("ss") - F.col("s")) / (F.col("nn") - F.col("n")), 3).alias("rest"))


@query("q_relative_to_first", "WITH m AS (SELECT event_type, CAST(hour(ts) AS INT) AS step, avg(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, step, round(v / first_value(v) OVER (PARTITION BY event_type ORDER BY step), 6) + 0.0 AS ratio FROM m")
def q_relative_to_first(table):
    """A curve over its first value."""
    m = table("events").groupBy("event_type", F.hour("ts").alias("step")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("event_type").orderBy("step")
    return m.select("event_type", "step", r(F.col("v") / F.first("v").over(w)).alias("ratio"))


@query("q_best_level", f"WITH c AS (SELECT arm, seed, avg(v) AS x FROM ({_CELL}) GROUP BY 1, 2) SELECT arm, arg_max(seed, x) AS best, round(max(x), 3) AS mean FROM c GROUP BY arm")
def q_best_level(table):
    """Each arm's best level."""
    c = _cells(table).groupBy("arm", "seed").agg(F.avg("v").alias("x"))
    b = c.groupBy("arm").agg(F.max(F.struct("x", (-F.col("seed")).alias("s"))).alias("b"))
    return b.select("arm", (-F.col("b.s")).alias("best"), F.round("b.x", 3).alias("mean"))
