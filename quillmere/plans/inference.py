"""Tests, regressions, spectra, resampling and gates on the standard tables."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from ..functions import tails
from ..operators import embedding as em
from ..operators import inference as inf
from .geometry import _LOGITS, _SEED_SQL, soft_labels
from .registry import UNIT_SQL, query, r, unit_vectors
from .softlabels import _TWO, two_models

_CELL = "SELECT o_orderpriority AS arm, CAST(year(o_orderdate) AS INT) AS seed, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2"
_NATION = "SELECT c_nationkey AS k, avg(c_acctbal) AS x, min(c_acctbal) AS y FROM customer GROUP BY 1"


def _t_sql(t: str, df: str) -> str:
    """Both tails of Student's t by Simpson's rule, as a correlated subquery."""
    return f"(SELECT 1 - 2 * sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(i * abs({t}) / 4000.0, 2) / ({df}), -(({df}) + 1) / 2.0)) * abs({t}) / 12000.0 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi()) FROM range(0, 4001) AS q(i))"


def _mass_sql(n: str, k: str, p: str) -> str:
    return f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"


def _cells(table):
    """Orders as runs: a priority for an arm, a year for a seed, the mean price for a result."""
    return table("orders").groupBy(F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("seed")).agg(F.avg("o_totalprice").alias("x"))


def _nations(table):
    return table("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("x"), F.min("c_acctbal").alias("y"))


@query(
    "q_ols_inference",
    f"""WITH m AS (SELECT count(*) AS n, var_pop(l_discount) AS v1, var_pop(l_quantity) AS v2, covar_pop(l_discount, l_quantity) AS c12, covar_pop(l_discount, l_tax) AS c1, covar_pop(l_quantity, l_tax) AS c2, var_pop(l_tax) AS vy FROM lineitem),
b AS (SELECT *, v1 * v2 - c12 * c12 AS det FROM m), c AS (SELECT *, (c1 * v2 - c2 * c12) / det AS b1, (c2 * v1 - c1 * c12) / det AS b2 FROM b), d AS (SELECT *, n * (vy - b1 * c1 - b2 * c2) AS rss FROM c),
t AS (SELECT 'l_discount' AS term, n, vy, rss, b1 AS est, sqrt(rss / (n - 3) * v2 / det / n) AS se FROM d UNION ALL SELECT 'l_quantity', n, vy, rss, b2, sqrt(rss / (n - 3) * v1 / det / n) FROM d)
SELECT term, round(est, 9) + 0.0 AS estimate, round(se, 9) AS se, round(est / se, 5) + 0.0 AS t, round({_t_sql('est / se', 'n - 3')}, 5) + 0.0 AS p, round(1 - rss / (n * vy), 8) AS r2, round(1 - rss / (n - 3) / (n * vy / (n - 1)), 8) + 0.0 AS adjusted_r2 FROM t""",
)
def q_ols_inference(table):
    """Two predictors with their errors, t and p from one pass of moments (M4)."""
    o = inf.ols(table("lineitem"), "l_tax", ["l_discount", "l_quantity"]).where("term <> 'intercept'")
    return o.select("term", r("estimate", 9).alias("estimate"), F.round("se", 9).alias("se"), r("t", 5).alias("t"), r("p", 5).alias("p"), F.round("r2", 8).alias("r2"), r("adjusted_r2", 8).alias("adjusted_r2"))


@query(
    "q_factorial_ols",
    """WITH c AS (SELECT (l_tax > 0.04)::INT AS a, (l_discount > 0.05)::INT AS b, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS ss FROM lineitem GROUP BY 1, 2),
w AS (SELECT sum(ss) / (sum(n) - 4) AS s2, max(m) FILTER (a = 0 AND b = 0) AS m00, max(m) FILTER (a = 1 AND b = 0) AS m10, max(m) FILTER (a = 0 AND b = 1) AS m01, max(m) FILTER (a = 1 AND b = 1) AS m11,
1.0 / max(n) FILTER (a = 0 AND b = 0) AS i00, 1.0 / max(n) FILTER (a = 1 AND b = 0) AS i10, 1.0 / max(n) FILTER (a = 0 AND b = 1) AS i01, 1.0 / max(n) FILTER (a = 1 AND b = 1) AS i11 FROM c)
SELECT 'intercept' AS term, round(m00, 6) AS estimate, round(sqrt(s2 * i00), 6) AS se FROM w UNION ALL SELECT 'a', round(m10 - m00, 6) + 0.0, round(sqrt(s2 * (i10 + i00)), 6) FROM w
UNION ALL SELECT 'b', round(m01 - m00, 6) + 0.0, round(sqrt(s2 * (i01 + i00)), 6) FROM w UNION ALL SELECT 'ab', round(m11 - m10 - m01 + m00, 6) + 0.0, round(sqrt(s2 * (i00 + i10 + i01 + i11)), 6) FROM w""",
)
def q_factorial_ols(table):
    """A two-by-two design with its interaction, as dummies (M6)."""
    d = table("lineitem").select("l_quantity", (F.col("l_tax") > 0.04).cast("int").alias("a"), (F.col("l_discount") > 0.05).cast("int").alias("b"))
    return inf.ols(d.withColumn("ab", F.col("a") * F.col("b")), "l_quantity", ["a", "b", "ab"]).select("term", r("estimate").alias("estimate"), F.round("se", 6).alias("se"))


@query("q_sign_test", f"WITH s AS (SELECT c_mktsegment AS segment, count(*) FILTER (c_acctbal > 4501) AS pos, count(*) FILTER (c_acctbal < 4499) AS neg FROM customer GROUP BY 1), u AS (SELECT *, (SELECT sum({_mass_sql('(pos + neg)', 'i', '0.5')}) FROM range(0, 100000) AS t(i) WHERE i >= pos AND i <= pos + neg) AS up, (SELECT sum({_mass_sql('(pos + neg)', 'i', '0.5')}) FROM range(0, 100000) AS t(i) WHERE i >= neg AND i <= pos + neg) AS down FROM s) SELECT segment, pos, neg, round(up, 7) AS upper_p, round(least(1, 2 * least(up, down)), 7) AS two_sided_p FROM u")
def q_sign_test(table):
    """Exact sign test, near-ties left out."""
    s = table("customer").select(F.col("c_mktsegment").alias("segment"), fn.sign_class(F.col("c_acctbal") - 4500, 1.0).alias("s"))
    c = s.groupBy("segment").agg(F.count_if(F.col("s") == "+").alias("pos"), F.count_if(F.col("s") == "-").alias("neg"))
    n = F.col("pos") + F.col("neg")
    c = c.withColumns({"up": tails.sign_p(F.col("pos"), n), "down": tails.sign_p(F.col("neg"), n)})
    return c.select("segment", "pos", "neg", F.round("up", 7).alias("upper_p"), F.round(F.least(F.lit(1.0), 2.0 * F.least("up", "down")), 7).alias("two_sided_p"))


@query("q_binomial_test", f"WITH c AS (SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (c_nationkey < 5) AS k FROM customer GROUP BY 1) SELECT segment, k, n, round((SELECT sum(CASE WHEN {_mass_sql('n', 'i', '0.2')} <= {_mass_sql('n', 'k', '0.2')} * 1.0000001 THEN {_mass_sql('n', 'i', '0.2')} ELSE 0 END) FROM range(0, 100000) AS t(i) WHERE i <= n), 7) AS p FROM c")
def q_binomial_test(table):
    """Exact binomial test against a fixed share, two-sided by mass."""
    c = table("customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_if(F.col("c_nationkey") < 5).alias("k"), F.count("*").alias("n"))
    return c.select("segment", "k", "n", F.round(tails.binomial_p(F.col("k"), F.col("n"), F.lit(0.2)), 7).alias("p"))


_GAIN = f"c AS ({_CELL}), g AS (SELECT a.arm, a.x - b.x AS g FROM c a JOIN c b USING (seed) WHERE b.arm = '1-URGENT' AND a.arm <> '1-URGENT'), t AS (SELECT arm, count(*) AS n, avg(g) AS mean, stddev_samp(g) / sqrt(count(*)) AS se FROM g GROUP BY arm)"


def _gains(table):
    c = _cells(table)
    base = c.where("arm = '1-URGENT'").select("seed", F.col("x").alias("base"))
    g = c.where("arm <> '1-URGENT'").join(base, "seed").select("arm", (F.col("x") - F.col("base")).alias("g"))
    t = g.groupBy("arm").agg(F.count("*").alias("n"), F.avg("g").alias("mean"), (F.stddev_samp("g") / F.sqrt(F.count("*").cast("double"))).alias("se"))
    return t.withColumn("p", tails.t_p(F.col("mean") / F.col("se"), (F.col("n") - 1).cast("double")))


@query("q_paired_interval", f"WITH {_GAIN}, k AS (SELECT *, list_value(12.7062047364, 4.3026527297, 3.1824463053, 2.7764451052, 2.5705818356, 2.4469118511, 2.3646242516, 2.3060041352, 2.2621571629)[n - 1] AS crit FROM t) SELECT arm, n, round(mean, 3) + 0.0 AS mean, round(mean - crit * se, 3) + 0.0 AS low, round(mean + crit * se, 3) + 0.0 AS high, round({_t_sql('mean / se', 'n - 1')}, 6) + 0.0 AS p FROM k")
def q_paired_interval(table):
    """Paired gains with 95 % intervals and two-sided p."""
    half = tails.t_quantile((F.col("n") - 1).cast("double")) * F.col("se")
    return _gains(table).select("arm", "n", r("mean", 3).alias("mean"), r(F.col("mean") - half, 3).alias("low"), r(F.col("mean") + half, 3).alias("high"), r("p").alias("p"))


@query("q_holm", f"WITH {_GAIN}, p AS (SELECT arm, {_t_sql('mean / se', 'n - 1')} AS p FROM t), s AS (SELECT arm, p, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, arm) + 1)) AS s FROM p) SELECT arm, round(p, 6) AS p, round(max(s) OVER (ORDER BY p, arm ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM s")
def q_holm(table):
    """Step-down adjustment over a family of paired tests."""
    return inf.holm(_gains(table), "p", "arm").select("arm", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


@query(
    "q_mixed_model",
    f"""WITH c AS ({_CELL}), g AS (SELECT seed, avg(x - 150000) AS m, var_samp(x) AS w, count(*) AS c FROM c GROUP BY seed), a AS (SELECT count(*) AS k, avg(c) AS c, sum(c) AS n, avg(m) AS mean, avg(c) * var_samp(m) AS msb, avg(w) AS msw FROM g),
v AS (SELECT *, (msb * (k - 1) + msw * (n - k)) / (n - 1) AS pooled, msb >= msw AS split FROM a), s AS (SELECT *, CASE WHEN split THEN sqrt(msb / n) ELSE sqrt(pooled / n) END AS se, CASE WHEN split THEN k - 1 ELSE n - 1 END AS df FROM v)
SELECT round(mean, 3) + 0.0 AS mean, round(se, 3) AS se, CAST(df AS DOUBLE) AS df, round({_t_sql('mean / se', 'df')}, 5) + 0.0 AS p, round(greatest(msb - msw, 0) / c, 1) AS var_between, round(mean / sqrt(pooled / n), 5) + 0.0 AS naive_t FROM s""",
)
def q_mixed_model(table):
    """Years as random effects of a balanced design."""
    m = inf.mixed_model(_cells(table).withColumn("x", F.col("x") - 150000), "seed", "x")
    return m.select(r("mean", 3).alias("mean"), F.round("se", 3).alias("se"), "df", r("p", 5).alias("p"), F.round("var_between", 1).alias("var_between"), r("naive_t", 5).alias("naive_t"))


@query("q_tost_sample_size")
def q_tost_sample_size(table):
    """How many pairs an equivalence test of each arm needs, its bound a deviation away from the mean's size (M9)."""
    g = _gains(table).select("arm", "mean", (F.col("se") * F.sqrt(F.col("n").cast("double"))).alias("sd"))
    return g.select("arm", tails.tost_n(F.col("mean"), F.col("sd"), F.abs("mean") + F.col("sd")).cast("long").alias("pairs"))


@query(
    "q_bootstrap_spearman",
    f"""WITH n AS (SELECT row_number() OVER (ORDER BY k) - 1 AS i, x, y FROM ({_NATION})), d AS (SELECT b, sha256('13' || chr(0) || CAST(b AS VARCHAR) || chr(0) || CAST(k AS VARCHAR)) AS h FROM range(10000) AS t(b), range((SELECT count(*) FROM n)) AS s(k)),
j AS (SELECT b, CAST(({_SEED_SQL}) % (SELECT count(*) FROM n)::UBIGINT AS BIGINT) AS i FROM d), v AS (SELECT b, x, y FROM j JOIN n USING (i)),
k AS (SELECT b, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY b ORDER BY y) + (count(*) OVER (PARTITION BY b, y) - 1) / 2.0 AS ry FROM v), c AS (SELECT b, corr(rx, ry) AS rho FROM k GROUP BY b)
SELECT round(avg(rho), 6) + 0.0 AS mean, round(quantile_cont(rho, 0.025), 6) + 0.0 AS low, round(quantile_cont(rho, 0.975), 6) + 0.0 AS high FROM c""",
)
def q_bootstrap_spearman(table):
    """Percentile interval of a rank correlation over classes."""
    classes = _nations(table).select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("k")) - 1).cast("long").alias("i"), "x", "y")
    b = inf.bootstrap_spearman(classes, "i", "x", "y", 10_000, 13)
    return b.agg(r(F.avg("rho")).alias("mean"), r(F.percentile("rho", 0.025)).alias("low"), r(F.percentile("rho", 0.975)).alias("high"))


@query("q_spectra")
def q_spectra(table):
    """Vendi score, participation and the first component's share of each label."""
    return inf.spectra(unit_vectors(table), "label", "unit").select("label", "n", F.round("vendi", 5).alias("vendi"), F.round("participation", 5).alias("participation"), F.round("first_share", 6).alias("first_share"))


_DIST = "list_sum(list_transform(range(1, 65), lambda i: (a.unit[i] - b.unit[i]) * (a.unit[i] - b.unit[i])))"


@query("q_mmd", f"WITH {UNIT_SQL}, h AS (SELECT vec_id, label < 5 AS side, unit FROM u), k AS (SELECT a.side AS sa, b.side AS sb, exp(-{_DIST} / 200) AS v FROM h a JOIN h b ON a.vec_id <> b.vec_id) SELECT round(1000 * (avg(v) FILTER (sa AND sb) + avg(v) FILTER (NOT sa AND NOT sb) - 2 * avg(v) FILTER (sa AND NOT sb)), 6) + 0.0 AS mmd FROM k")
def q_mmd(table):
    """Unbiased Gaussian discrepancy between two halves of the labels."""
    return inf.kernel_discrepancy(unit_vectors(table).withColumn("side", F.col("label") < 5), "side", "unit").select(r("mmd").alias("mmd"))


_GRID = [math.exp(-1.5 + 0.1 * k) for k in range(41)]


@query(
    "q_temperature_crossfit",
    f"""WITH {_LOGITS}, o AS (SELECT vec_id, label, list_transform(p, lambda v: ln(v)) AS z, CAST((row_number() OVER (PARTITION BY label ORDER BY sha256('5' || chr(0) || CAST(vec_id AS VARCHAR))) - 1) % 5 AS INT) AS fold FROM f),
n AS (SELECT fold, exp(-1.5 + 0.1 * k) AS t, ln(list_sum(list_transform(z, lambda v: exp(v / exp(-1.5 + 0.1 * k))))) - z[label + 1] / exp(-1.5 + 0.1 * k) AS loss FROM o, range(41) AS r(k)), a AS (SELECT fold, t, sum(loss) AS s, count(*) AS n FROM n GROUP BY ALL),
b AS (SELECT *, round((sum(s) OVER (PARTITION BY t) - s) / (sum(n) OVER (PARTITION BY t) - n), 9) AS train FROM a) SELECT fold, round(t, 6) AS temperature, round(s / n, 6) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train, t) AS k FROM b) WHERE k = 1""",
)
def q_temperature_crossfit(table):
    """Each fold's temperature is fit on the others."""
    d = soft_labels(table).select("label", F.transform("p", lambda v: F.log(v)).alias("z"), op.hash_fold("label", 5, "vec_id", 5).alias("fold"))
    return inf.crossfit_temperature(d, "z", "label", "fold", _GRID).select("fold", F.round("temperature", 6).alias("temperature"), F.round("loss", 6).alias("loss"))


@query("q_match_temperature")
def q_match_temperature(table):
    """The temperature whose mean entropy is half of its largest value."""
    d = soft_labels(table).select(F.transform("p", lambda v: F.log(v)).alias("z"))
    t = inf.match_entropy(d, "z", math.log(10) / 2)
    return d.agg(F.round(F.lit(t), 6).alias("temperature"), F.round(F.avg(fn.entropy(fn.softmax(F.col("z"), t))), 6).alias("entropy"))


@query("q_drift_concentration", f"WITH {_TWO}, d AS (SELECT label, vec_id, i, q[i] - p[i] AS d FROM two, range(1, 11) AS t(i)), c AS (SELECT label, i, sum(d) AS s, sum(d * d) AS ss, count(*) AS n FROM d GROUP BY label, i) SELECT label, round(sum(s * s) / (max(n) * sum(ss)), 6) AS kappa FROM c GROUP BY label")
def q_drift_concentration(table):
    """How far changes of the label vectors point one way."""
    d = two_models(table).select("label", F.posexplode(F.zip_with("p", "q", lambda x, y: y - x)).alias("i", "d"))
    c = d.groupBy("label", "i").agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"), F.count("*").alias("n"))
    return c.groupBy("label").agg(F.round(F.sum(F.col("s") * F.col("s")) / (F.max("n") * F.sum("ss")), 6).alias("kappa"))


@query("q_matrix_change", f"WITH {_TWO}, m AS (SELECT label, i, avg(q[i]) - avg(p[i]) AS d FROM two, range(1, 11) AS t(i) GROUP BY label, i), c AS (SELECT i, avg(d) AS m FROM m GROUP BY i) SELECT (SELECT round(sum(abs(d)), 6) FROM m) AS l1, (SELECT round(sqrt(sum(d * d)), 6) FROM m) AS frobenius, (SELECT round(max(abs(m)), 6) FROM c) AS largest_column")
def q_matrix_change(table):
    """Change of the class-by-class mean matrix."""
    m = two_models(table).select("label", F.posexplode(F.zip_with("p", "q", lambda x, y: y - x)).alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("d"))
    c = m.groupBy("i").agg(F.sum(F.abs("d")).alias("l1"), F.sum(F.col("d") * F.col("d")).alias("ss"), F.avg("d").alias("m"))
    return c.agg(F.round(F.sum("l1"), 6).alias("l1"), F.round(F.sqrt(F.sum("ss")), 6).alias("frobenius"), F.round(F.max(F.abs("m")), 6).alias("largest_column"))


@query("q_half_split", f"WITH {UNIT_SQL}, s AS (SELECT label, i, sum(unit[i]) FILTER (vec_id % 2 = 0) AS a, sum(unit[i]) FILTER (vec_id % 2 = 1) AS b FROM u, range(1, 65) AS t(i) GROUP BY label, i) SELECT label, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) + 0.0 AS cosine FROM s GROUP BY label")
def q_half_split(table):
    """Agreement of prototypes from two halves of a label."""
    x = unit_vectors(table).select("label", (F.col("vec_id") % 2).alias("h"), F.posexplode("unit").alias("i", "v"))
    s = x.groupBy("label", "i").agg(F.sum(F.when(F.col("h") == 0, F.col("v"))).alias("a"), F.sum(F.when(F.col("h") == 1, F.col("v"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return s.groupBy("label").agg(r(F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"))


@query(
    "q_order_gate",
    f"""WITH c AS ({_CELL}), w AS (SELECT arm, seed, x, rank() OVER (PARTITION BY arm ORDER BY x) + (count(*) OVER (PARTITION BY arm, x) - 1) / 2.0 AS ry, x < lag(x) OVER (PARTITION BY arm ORDER BY seed) AS fell FROM c),
s AS (SELECT arm, count(*) AS n, count(*) FILTER (fell) AS falls, corr(seed, ry) AS rho, corr(seed, x) AS r, max_by(x, seed) AS last, avg(x) AS mean FROM w GROUP BY arm)
SELECT arm, falls, round(rho, 6) + 0.0 AS rho, round({_t_sql('(r * sqrt((n - 2) / (1 - r * r)))', 'n - 2')}, 6) + 0.0 AS p, rho >= 0.7 AND falls = 0 AS ordered, last >= mean - 1000 AS held FROM s""",
)
def q_order_gate(table):
    """Falls along the years, rank correlation, the line's p, and two gates."""
    w = Window.partitionBy("arm")
    d = _cells(table).select("arm", "seed", "x", op.average_rank("x", "arm").alias("ry"), (F.col("x") < F.lag("x").over(w.orderBy("seed"))).alias("fell"))
    s = d.groupBy("arm").agg(F.count("*").alias("n"), F.count_if("fell").alias("falls"), fn.correlation(F.col("seed"), F.col("ry")).alias("rho"), fn.correlation(F.col("seed"), F.col("x")).alias("c"), F.max_by("x", "seed").alias("last"), F.avg("x").alias("mean"))
    t = F.col("c") * F.sqrt((F.col("n") - 2) / (1 - F.col("c") * F.col("c")))
    return s.select("arm", "falls", r("rho").alias("rho"), r(tails.t_p(t, (F.col("n") - 2).cast("double"))).alias("p"), ((F.col("rho") >= 0.7) & (F.col("falls") == 0)).alias("ordered"), (F.col("last") >= F.col("mean") - 1000).alias("held"))


@query("q_pair_subsample", "WITH k AS (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('17' || chr(0) || CAST(c_custkey AS VARCHAR))) AS n FROM customer) SELECT c_nationkey, round(avg(c_acctbal), 4) + 0.0 AS whole, round(avg(c_acctbal) FILTER (n <= 2), 4) + 0.0 AS pair FROM k GROUP BY 1")
def q_pair_subsample(table):
    """The mean of two hash-drawn rows of each parent beside that of all (M31): a sampling operator."""
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(fn.sampling_key(F.lit(17), F.col("c_custkey"))))
    return table("customer").withColumn("n", n).groupBy("c_nationkey").agg(r(F.avg("c_acctbal"), 4).alias("whole"), r(F.avg(F.when(F.col("n") <= 2, F.col("c_acctbal"))), 4).alias("pair"))


@query("q_pooled_rank_corr", "WITH k AS (SELECT (rank() OVER (PARTITION BY lang ORDER BY n_chars) - 1 + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0) / greatest(count(*) OVER (PARTITION BY lang) - 1, 1) AS a, (rank() OVER (PARTITION BY lang ORDER BY doc_id) - 1) / CAST(greatest(count(*) OVER (PARTITION BY lang) - 1, 1) AS DOUBLE) AS b FROM documents) SELECT round(corr(a, b), 6) + 0.0 AS rho FROM k")
def q_pooled_rank_corr(table):
    """Correlation of ranks taken within groups and pooled (M3)."""
    k = table("documents").select(op.average_tie_percentile("n_chars", "lang").alias("a"), op.average_tie_percentile("doc_id", "lang").alias("b"))
    return k.agg(r(fn.correlation(F.col("a"), F.col("b"))).alias("rho"))


@query("q_kendall", f"WITH n AS ({_NATION}) SELECT round(avg(sign((a.x - b.x) * (a.y - b.y))), 6) + 0.0 AS tau FROM n a JOIN n b ON a.k < b.k")
def q_kendall(table):
    """Kendall's tau over classes (M2)."""
    return inf.kendall(_nations(table), "k", "x", "y").select(r("tau").alias("tau"))


@query("q_mixed_model_unequal")
def q_mixed_model_unequal(table):
    """Customers as random effects, order priorities as fixed ones, in groups of unequal size (M14); tested against a search with whole matrices."""
    d = table("orders").select("o_custkey", "o_orderpriority", (F.col("o_totalprice") / 1000).alias("x"))
    m = inf.mixed_model(d, "o_custkey", "x", "o_orderpriority")
    return m.select(r("mean", 4).alias("mean"), r("se", 4).alias("se"), r("df", 1).alias("df"), r("var_between", 2).alias("var_between"), r("var_within", 2).alias("var_within"))


_BISECT = """
m(f, k, low, high) AS (SELECT fold, 0, CAST(-6 AS DOUBLE), CAST(6 AS DOUBLE) FROM (SELECT DISTINCT fold FROM o)
  UNION ALL SELECT f, k + 1, CASE WHEN slope <= 0 THEN (low + high) / 2 ELSE low END, CASE WHEN slope <= 0 THEN high ELSE (low + high) / 2 END
  FROM (SELECT f, k, low, high, sum(s[label + 1] - list_dot_product(s, list_transform(s, lambda v: exp(v))) / list_sum(list_transform(s, lambda v: exp(v)))) AS slope
        FROM (SELECT f, k, low, high, label, list_transform(z, lambda v: v / exp((low + high) / 2)) AS s FROM m JOIN o ON o.fold <> m.f WHERE k < 45) GROUP BY ALL))"""


@query(
    "q_fitted_temperature",
    f"""WITH RECURSIVE {_LOGITS}, o AS (SELECT vec_id, label, list_transform(p, lambda v: ln(v)) AS z, CAST((row_number() OVER (PARTITION BY label ORDER BY sha256('5' || chr(0) || CAST(vec_id AS VARCHAR))) - 1) % 5 AS INT) AS fold FROM f), {_BISECT},
t AS (SELECT f, exp((low + high) / 2) AS t FROM m WHERE k = 45)
SELECT CAST(f AS BIGINT) AS fold, round(t, 6) AS temperature, round(avg(ln(list_sum(list_transform(z, lambda v: exp(v / t)))) - z[label + 1] / t), 6) AS loss FROM t JOIN o ON o.fold = f GROUP BY f, t""",
)
def q_fitted_temperature(table):
    """Each fold's temperature, minimised freely over the other folds."""
    d = soft_labels(table).select("label", F.transform("p", lambda v: F.log(v)).alias("z"), op.hash_fold("label", 5, "vec_id", 5).alias("fold"))
    return inf.fitted_temperature(d, "z", "label", "fold").select("fold", F.round("temperature", 6).alias("temperature"), F.round("loss", 6).alias("loss"))


_APART = "round(sqrt(list_sum(list_transform(range(1, {n} + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))), 9)"


@query(
    "q_trustworthiness",
    f"""WITH {UNIT_SQL}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, {_APART.format(n=64, a='a.unit', b='b.unit')} AS h, {_APART.format(n=2, a='a.unit', b='b.unit')} AS l FROM u a JOIN u b ON a.vec_id <> b.vec_id),
k AS (SELECT row_number() OVER (PARTITION BY i ORDER BY h, j) AS h, row_number() OVER (PARTITION BY i ORDER BY l, j) AS l FROM d), n AS (SELECT count(*) AS n FROM u)
SELECT n, round(1 - 2 * (SELECT sum(greatest(h - 5, 0)) FROM k WHERE l <= 5) / (n * 5.0 * (2 * n - 16)), 6) AS trust FROM n""",
)
def q_trustworthiness(table):
    """How well the first two dimensions picture the vectors (M27): exact ranks by counting nearer vectors."""
    unit = unit_vectors(table).select("vec_id", F.col("unit").alias("x"), F.slice("unit", 1, 2).alias("y"))
    return em.trustworthiness(unit, 5).select("n", F.round("trust", 6).alias("trust"))


@query("q_principal_plane")
def q_principal_plane(table):
    """Scores on the first two components (M27); tested against a singular value decomposition."""
    scores, _ = em.principal_components(unit_vectors(table).withColumnRenamed("unit", "x"), 2)
    return scores.select("vec_id", *(r(F.col("scores")[k]).alias(f"pc{k + 1}") for k in range(2)))
