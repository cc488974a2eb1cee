"""Soft-label algebra on synthetic soft labels: parents, committees, mixtures, orders, comparisons of two models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from ..functions import softlabels as sl
from .geometry import _ENTROPY, _LOGITS, soft_labels
from .registry import query, r, unit_vectors

_PARENTS = [k % 2 for k in range(10)]
#: A second model: the first one's probabilities, tilted by place and rescaled.
_TILT = [1.0 + 0.3 * (k % 3) for k in range(10)]
_TWO = _LOGITS + ", w AS (SELECT *, list_transform(range(1, 11), lambda i: p[i] * (1 + 0.3 * ((i - 1) % 3))) AS t FROM f), two AS (SELECT vec_id, label, p, list_transform(t, lambda v: v / list_sum(t)) AS q FROM w)"


def two_models(table):
    tilt = F.array(*(F.lit(x) for x in _TILT))
    return soft_labels(table).withColumn("q", sl.rescaled(F.zip_with("p", tilt, lambda x, y: x * y)))


@query("q_parent_entropy", f"WITH {_LOGITS}, o AS (SELECT vec_id, list_transform(range(label % 2 + 1, 11, 2), lambda i: p[i]) AS s FROM f), n AS (SELECT vec_id, list_transform(s, lambda v: v / list_sum(s)) AS p FROM o) SELECT vec_id, round({_ENTROPY} / ln(5), 6) + 0.0 AS entropy FROM n")
def q_parent_entropy(table):
    """Entropy within the target's parent (L2)."""
    return soft_labels(table).select("vec_id", r(sl.entropy_within_parent(F.col("p"), _PARENTS, F.col("label") % 2)).alias("entropy"))


@query("q_parent_logits", f"WITH {_LOGITS}, pool AS (SELECT vec_id, p[1] + p[3] + p[5] + p[7] + p[9] AS even, p[2] + p[4] + p[6] + p[8] + p[10] AS odd FROM f), z AS (SELECT vec_id, list_transform(p, lambda v: 2 * ln(v)) AS z FROM f), c AS (SELECT vec_id, ln(exp(z[1]) + exp(z[3]) + exp(z[5]) + exp(z[7]) + exp(z[9])) AS a, ln(exp(z[2]) + exp(z[4]) + exp(z[6]) + exp(z[8]) + exp(z[10])) AS b FROM z) SELECT vec_id, round(2 * ln(even), 6) + 0.0 AS even, round(2 * ln(odd), 6) + 0.0 AS odd, round((a - b) / 2, 6) + 0.0 AS pooled FROM pool JOIN c USING (vec_id)")
def q_parent_logits(table):
    """Log-marginal logits at a temperature, and pooled logits, centred (L3, L4)."""
    m = F.transform(fn.marginalised(F.col("p"), _PARENTS), lambda x: 2.0 * F.log(x))
    pooled = sl.pooled_logits(sl.equivalent_logits(F.col("p"), 2.0), _PARENTS)
    return soft_labels(table).select("vec_id", m.alias("m"), pooled.alias("l")).select("vec_id", r(F.col("m")[0]).alias("even"), r(F.col("m")[1]).alias("odd"), r(F.col("l")[0]).alias("pooled"))


@query("q_committee", f"WITH {_TWO}, k AS (SELECT exp(0.0) AS a, exp(-1.3) AS b), c AS (SELECT vec_id, list_transform(range(1, 11), lambda i: (a * p[i] + b * q[i]) / (a + b)) AS p FROM two, k) SELECT vec_id, round(list_max(p), 6) AS top, round({_ENTROPY}, 6) + 0.0 AS entropy FROM c")
def q_committee(table):
    """Two models weighted by the softmax of their accuracies over ten."""
    c = two_models(table).select("vec_id", sl.committee([F.col("p"), F.col("q")], [84.0, 71.0]).alias("c"))
    return c.select("vec_id", F.round(F.array_max("c"), 6).alias("top"), r(fn.entropy(F.col("c"))).alias("entropy"))


@query(
    "q_mixture_mass",
    f"""WITH {_LOGITS}, m AS (SELECT a.vec_id, a.p, a.label AS la, b.label AS lb, (a.vec_id * 37 % 100) / 100.0 AS lam FROM f a JOIN f b ON b.vec_id // 20 = a.vec_id // 20 AND b.vec_id % 20 = (a.vec_id + 7) % 20),
main_ AS (SELECT *, CASE WHEN lam >= 0.5 THEN la ELSE lb END AS main, list_position(p, list_max(p)) - 1 AS best FROM m)
SELECT vec_id, round(p[la + 1] + CASE WHEN la = lb THEN 0 ELSE p[lb + 1] END, 6) AS mass, round(lam * p[la + 1] + (1 - lam) * p[lb + 1], 6) AS weighted, round(-lam * ln(p[la + 1]) - (1 - lam) * ln(p[lb + 1]), 6) + 0.0 AS ce, best = main AS dominant, best = la OR best = lb AS either,
round(p[main + 1] - list_max(list_filter(p, lambda v, i: i - 1 <> main)), 6) + 0.0 AS margin FROM main_""",
)
def q_mixture_mass(table):
    """Two-source rows: the partner is gathered within the batch, then mass, weighted probability, cross-entropy of the hard mixture,
    accuracies and margin (L7, L19, J21, F16)."""
    d = soft_labels(table).withColumns({"batch": F.floor(F.col("vec_id") / 20), "row": F.col("vec_id") % 20})
    partner = d.select("batch", F.col("row").alias("mix_row"), F.col("label").alias("lb"))
    m = d.withColumn("mix_row", (F.col("row") + 7) % 20).join(partner, ["batch", "mix_row"]).withColumn("lam", (F.col("vec_id") * 37 % 100) / 100.0)
    at = lambda c: F.element_at("p", F.col(c) + 1)
    lam, best = F.col("lam"), fn.first_arg_max(F.col("p"))
    g = m.withColumns({"main": F.when(lam >= 0.5, F.col("label")).otherwise(F.col("lb")), "best": best})
    mass = at("label") + F.when(F.col("label") == F.col("lb"), 0.0).otherwise(at("lb"))
    ce = lam * fn.negative_log(at("label")) + (1 - lam) * fn.negative_log(at("lb"))
    rest = F.array_max(F.filter("p", lambda x, i: i != F.col("main")))
    return g.select("vec_id", F.round(mass, 6).alias("mass"), F.round(lam * at("label") + (1 - lam) * at("lb"), 6).alias("weighted"), r(ce).alias("ce"), (F.col("best") == F.col("main")).alias("dominant"), ((F.col("best") == F.col("label")) | (F.col("best") == F.col("lb"))).alias("either"), r(at("main") - rest).alias("margin"))


@query("q_reorder", f"WITH {_LOGITS}, srt AS (SELECT vec_id, label, p, list_sort(list_concat(p[1:label], p[label + 2:]), 'DESC') AS s FROM f), n AS (SELECT vec_id, p, list_transform(range(10), lambda i: CASE WHEN i = label THEN p[label + 1] WHEN i > label THEN s[10 - i] ELSE s[9 - i] END) AS q FROM srt) SELECT vec_id, round(list_sum(list_transform(range(1, 11), lambda i: abs(p[i] - q[i]))), 6) + 0.0 AS moved, round(list_sum(q), 6) AS mass FROM n")
def q_reorder(table):
    """Other classes' values in falling order along a fixed list of places, the last place first."""
    places = F.filter(F.array(*(F.lit(k) for k in range(9, -1, -1))), lambda i: i != F.col("label"))
    d = soft_labels(table).withColumn("q", sl.reordered(F.col("p"), F.col("label"), places))
    return d.select("vec_id", r(fn.total(F.zip_with("p", "q", lambda x, y: F.abs(x - y)))).alias("moved"), F.round(fn.total(F.col("q")), 6).alias("mass"))


@query(
    "q_derangement",
    """WITH k AS (SELECT vec_id, label, i, sha256('9' || chr(0) || CAST(vec_id AS VARCHAR) || chr(0) || CAST(i AS VARCHAR)) AS h FROM embeddings, range(10) AS t(i) WHERE label IS NOT NULL),
o AS (SELECT vec_id, i, coalesce(lead(i) OVER w, first_value(i) OVER w) AS dest FROM k WHERE i <> label WINDOW w AS (PARTITION BY vec_id ORDER BY h))
SELECT vec_id, string_agg(CAST(coalesce(dest, i) AS VARCHAR), ',' ORDER BY i) AS places FROM k LEFT JOIN o USING (vec_id, i) GROUP BY vec_id""",
)
def q_derangement(table):
    """Identity-keyed moves of the other classes' places: none stays."""
    d = table("embeddings").where("label is not null")
    return d.select("vec_id", F.array_join(F.transform(sl.derangement(F.col("vec_id"), 9, F.col("label"), 10), lambda i: i.cast("string")), ",").alias("places"))


@query("q_mixed_target", f"WITH {_LOGITS}, t AS (SELECT label, i - 1 AS pos, CASE WHEN vec_id % 3 <> 0 THEN p[i] WHEN i - 1 = label THEN 1.0 ELSE 0.0 END AS v FROM f, range(1, 11) AS r(i)) SELECT label, CAST(pos AS INT) AS pos, round(avg(v), 6) + 0.0 AS mean FROM t GROUP BY label, pos")
def q_mixed_target(table):
    """Hard targets by a mask, soft ones elsewhere, as a class-by-class mean matrix."""
    t = F.when(F.col("vec_id") % 3 == 0, sl.one_hot(F.col("label"), 10)).otherwise(F.col("p"))
    return soft_labels(table).select("label", F.posexplode(t).alias("pos", "v")).groupBy("label", "pos").agg(r(F.avg("v")).alias("mean"))


@query("q_view_mean", f"WITH {_LOGITS}, h AS (SELECT vec_id // 16 AS item, {_ENTROPY} AS e FROM f) SELECT CAST(item AS BIGINT) AS item, count(*) AS views, CASE WHEN count(*) = 16 THEN round(avg(e), 6) END AS entropy FROM h GROUP BY item")
def q_view_mean(table):
    """The mean over sixteen views of an item, null where one is missing or too many."""
    h = soft_labels(table).groupBy(F.floor(F.col("vec_id") / 16).alias("item")).agg(F.count("*").alias("views"), F.avg(fn.entropy(F.col("p"))).alias("e"))
    return h.select("item", "views", F.when(F.col("views") == 16, F.round("e", 6)).alias("entropy"))


@query("q_crop_choice", f"WITH {_LOGITS}, c AS (SELECT label, vec_id // 8 AS item, vec_id, round(-ln(p[label + 1]), 9) AS ce FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY label, item ORDER BY ce, vec_id) AS n FROM c), slots AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ce, vec_id) AS k FROM b WHERE n = 1) SELECT label, vec_id, round(ce, 6) + 0.0 AS ce, CAST(k - 1 AS INT) AS slot FROM slots WHERE k <= 5")
def q_crop_choice(table):
    """Each item's best crop by cross-entropy, then the best items of each label."""
    c = soft_labels(table).select("label", F.floor(F.col("vec_id") / 8).alias("item"), F.struct(F.round(fn.negative_log(F.element_at("p", F.col("label") + 1)), 9).alias("ce"), "vec_id").alias("s"))
    best = c.groupBy("label", "item").agg(F.min("s").alias("b")).select("label", "b.ce", "b.vec_id")
    return op.top_per_group(best, 5, "label", F.col("ce"), F.col("vec_id")).select("label", "vec_id", r("ce").alias("ce"), "slot")


@query("q_mosaic_tiles", f"WITH {_LOGITS}, k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(-ln(p[label + 1]), 9), vec_id) - 1 AS n FROM f) SELECT label, vec_id, CAST(n // 4 AS INT) AS tile, CAST(n % 4 AS INT) AS corner FROM k")
def q_mosaic_tiles(table):
    """Four neighbours in rank share a tile."""
    c = soft_labels(table).select("label", "vec_id", F.round(fn.negative_log(F.element_at("p", F.col("label") + 1)), 9).alias("ce"))
    n = F.row_number().over(Window.partitionBy("label").orderBy("ce", "vec_id")) - 1
    return c.withColumn("n", n).select("label", "vec_id", F.floor(F.col("n") / 4).cast("int").alias("tile"), (F.col("n") % 4).cast("int").alias("corner"))


@query("q_logit_geometry", f"WITH {_LOGITS}, z AS (SELECT p, list_transform(p, lambda v: 20 * ln(v)) AS z FROM f), c AS (SELECT list_max(p) AS top, list_transform(z, lambda v: v - list_sum(z) / 10) AS c FROM z) SELECT round(sqrt(sum(list_sum(list_transform(c, lambda v: v * v))) / (10 * count(*))), 5) AS sd, round(avg(top), 6) AS mean_top FROM c")
def q_logit_geometry(table):
    """Pooled deviation of the centred equivalent logits and the mean largest probability."""
    c = soft_labels(table).select(F.array_max("p").alias("top"), F.size("p").alias("n"), fn.total(F.transform(sl.equivalent_logits(F.col("p"), 20.0), lambda v: v * v)).alias("ss"))
    return c.agg(F.round(F.sqrt(F.sum("ss") / F.sum("n")), 5).alias("sd"), F.round(F.avg("top"), 6).alias("mean_top"))


@query("q_mass_map", "WITH e AS (SELECT label, list_transform(CAST(embedding AS DOUBLE[]), lambda v: greatest(v, 0)) AS m FROM embeddings WHERE label IS NOT NULL), s AS (SELECT label, list_transform(m, lambda v: v / list_sum(m)) AS p FROM e WHERE list_sum(m) > 1e-15), c AS (SELECT label, -list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) / ln(64) AS h, list_sum(list_transform(range(64), lambda i: p[i + 1] * (i // 8))) AS y, list_sum(list_transform(range(64), lambda i: p[i + 1] * (i % 8))) AS x FROM s) SELECT label, round(avg(h), 6) AS entropy, round(var_samp(y), 6) AS var_y, round(var_samp(x), 6) AS var_x FROM c GROUP BY label")
def q_mass_map(table):
    """Entropy and spread of the centroid of positive mass on an 8 by 8 map; empty maps count for nothing."""
    mass = F.transform(fn.doubles(F.col("embedding")), lambda v: F.greatest(v, F.lit(0.0)))
    m = table("embeddings").where("label is not null").select("label", sl.mass_map(mass, 8).alias("m"))
    return m.groupBy("label").agg(F.round(F.avg("m.entropy"), 6).alias("entropy"), F.round(F.var_samp("m.y"), 6).alias("var_y"), F.round(F.var_samp("m.x"), 6).alias("var_x"))


_KL = "list_sum(list_transform(range(1, 11), lambda i: {0}[i] * (ln({0}[i]) - ln({1}[i]))))"


@query("q_model_pair", f"WITH {_TWO}, m AS (SELECT *, list_transform(range(1, 11), lambda i: (p[i] + q[i]) / 2) AS h FROM two) SELECT label, round(avg((list_position(p, list_max(p)) = list_position(q, list_max(q)))::INT), 6) AS agreement, round(avg(list_sum(list_transform(range(1, 11), lambda i: abs(p[i] - q[i])))), 6) AS l1, round(avg(({_KL.format('p', 'q')} + {_KL.format('q', 'p')}) / 2), 6) + 0.0 AS symmetric_kl, round(avg(({_KL.format('p', 'h')} + {_KL.format('q', 'h')}) / 2 / ln(2)), 6) + 0.0 AS js_bits FROM m GROUP BY label")
def q_model_pair(table):
    """Agreement and divergences of two models."""
    p, q = F.col("p"), F.col("q")
    return two_models(table).groupBy("label").agg(
        F.round(F.avg((fn.first_arg_max(p) == fn.first_arg_max(q)).cast("int")), 6).alias("agreement"),
        F.round(F.avg(fn.total(F.zip_with(p, q, lambda x, y: F.abs(x - y)))), 6).alias("l1"),
        r(F.avg((fn.kl_divergence(p, q) + fn.kl_divergence(q, p)) / 2)).alias("symmetric_kl"),
        r(F.avg(fn.jensen_shannon_bits(p, q))).alias("js_bits"),
    )


@query("q_error_changes", f"WITH {_TWO}, err AS (SELECT list_position(p, list_max(p)) - 1 <> label AS a, list_position(q, list_max(q)) - 1 <> label AS b, len(list_filter(q, lambda v: v > q[label + 1])) + 1 AS rank FROM two) SELECT CAST(rank AS INT) AS rank, count(*) AS n, count(*) FILTER (b AND NOT a) AS added, count(*) FILTER (a AND NOT b) AS fixed FROM err GROUP BY rank")
def q_error_changes(table):
    """The target's rank under the second model, with errors it adds and mends."""
    own = F.element_at("q", F.col("label") + 1)
    e = two_models(table).select((fn.first_arg_max(F.col("p")) != F.col("label")).alias("a"), (fn.first_arg_max(F.col("q")) != F.col("label")).alias("b"), (F.size(F.filter("q", lambda v: v > own)) + 1).alias("rank"))
    return e.groupBy("rank").agg(F.count("*").alias("n"), F.count_if(F.col("b") & ~F.col("a")).alias("added"), F.count_if(F.col("a") & ~F.col("b")).alias("fixed"))


@query("q_temperature_entropy", f"WITH {_LOGITS}, t AS (SELECT vec_id, p, -ln(p[label + 1]) AS ce, list_transform(p, lambda v: exp(ln(v) / 20)) AS s FROM f), n AS (SELECT vec_id, p AS p1, ce, list_transform(s, lambda v: v / list_sum(s)) AS p FROM t) SELECT vec_id, round(-list_sum(list_transform(p1, lambda v: v * ln(v))), 6) + 0.0 AS h1, round({_ENTROPY}, 6) AS h20, round(ce, 6) + 0.0 AS ce FROM n")
def q_temperature_entropy(table):
    """Entropy at two temperatures and the target's cross-entropy."""
    hot = fn.softmax(F.transform("p", lambda v: F.log(F.greatest(v, F.lit(1e-30)))), 20.0)
    return soft_labels(table).select("vec_id", r(fn.entropy(F.col("p"))).alias("h1"), F.round(fn.entropy(hot), 6).alias("h20"), r(fn.negative_log(F.element_at("p", F.col("label") + 1))).alias("ce"))


@query("q_confusable", f"WITH {_LOGITS}, m AS (SELECT label AS a, i - 1 AS b, avg(p[i]) AS v FROM f, range(1, 11) AS t(i) GROUP BY ALL), sym AS (SELECT x.a, x.b, round((x.v + y.v) / 2, 9) AS v FROM m x JOIN m y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY v DESC, b) AS n FROM sym) SELECT a AS label, CAST(b AS INT) AS neighbour, CAST(n - 1 AS INT) AS slot, round(v, 6) AS mean FROM k WHERE n <= 3")
def q_confusable(table):
    """The three classes each class is most confused with, by the symmetrised mean matrix (C20)."""
    m = soft_labels(table).select("label", F.posexplode("p").alias("b", "v")).groupBy("label", "b").agg(F.avg("v").alias("v"))
    both = F.explode(F.array(F.struct(F.col("label").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("label").alias("b"))))
    s = m.where("label <> b").select(both.alias("k"), "v").groupBy("k.a", "k.b").agg(F.round(F.sum("v") / 2, 9).alias("v"))
    return op.top_per_group(s.withColumnRenamed("a", "label"), 3, "label", F.desc("v"), F.col("b")).select("label", F.col("b").alias("neighbour"), "slot", F.round("v", 6).alias("mean"))


@query(
    "q_gradient_alignment",
    f"""
    WITH {_TWO}, t1 AS (SELECT two.vec_id, two.label, list_transform(range(1, 11), lambda k: p[k] - CASE WHEN k = two.label + 1 THEN 1 ELSE 0 END) AS d,
      list_transform(p, lambda x: pow(x, 0.05)) AS a, list_transform(q, lambda x: pow(x, 0.05)) AS b, list_append(u.unit, CAST(1 AS DOUBLE)) AS h FROM two JOIN u ON u.vec_id = two.vec_id),
    s1 AS (SELECT vec_id, label, d, h, list_transform(range(1, 11), lambda k: (a[k] / list_sum(a) - b[k] / list_sum(b)) / 20) AS e FROM t1),
    g1 AS (SELECT label, k, i, avg(d[k] * h[i]) AS v, count(*) AS n FROM s1, range(1, 11) AS x(k), range(1, 66) AS y(i) GROUP BY label, k, i),
    o1 AS (SELECT label, k, i, v, n, (sum(v) OVER (PARTITION BY k, i) - v) / (count(*) OVER (PARTITION BY k, i) - 1) AS w FROM g1),
    z1 AS (SELECT s1.vec_id, s1.label, any_value(n) AS n, sum(e[k] * v * h[i]) AS own, sum(e[k] * w * h[i]) AS other, any_value(list_dot_product(e, d) * list_dot_product(h, h)) AS itself
          FROM s1 JOIN o1 ON o1.label = s1.label GROUP BY s1.vec_id, s1.label),
    r1 AS (SELECT label, vec_id, round(0.5 * (n * own - itself) / (n - 1) + 0.5 * other, 9) AS score FROM z1)
    SELECT label, vec_id, round(score, 7) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM r1) WHERE k = 1""",
)
def q_gradient_alignment(table):
    """The row of each class whose soft target's gradient agrees best with its class, itself left out, and with the others."""
    hard = F.transform("p", lambda x, k: x - F.when(k == F.col("label"), 1.0).otherwise(0.0))
    cooled = lambda c: sl.rescaled(F.transform(c, lambda x: F.pow(x, F.lit(0.05))))
    soft = F.zip_with(cooled("p"), cooled("q"), lambda x, y: (x - y) / 20)
    d = two_models(table).select("vec_id", "label", hard.alias("delta"), soft.alias("soft")).join(unit_vectors(table).select("vec_id", F.array_append("unit", 1.0).alias("h")), "vec_id")
    scored = op.gradient_alignment(d, "vec_id", "label", "delta", "soft", "h").withColumn("score", F.round("score", 9))
    best = scored.groupBy("label").agg(F.min(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("b"))
    return best.select("label", "b.vec_id", r(-F.col("b.s"), 7).alias("score"))
