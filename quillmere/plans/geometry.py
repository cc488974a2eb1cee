"""Embedding geometry, deterministic selection, soft labels, clustering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from .registry import PROTO_SQL, UNIT_SQL, query, r, unit_vectors


def _margins(table):
    unit = unit_vectors(table)
    return op.margins(unit, op.prototypes(unit))


_MARGIN_SQL = (
    PROTO_SQL
    + """,
m AS (SELECT vec_id, label, max(sim) FILTER (p_label = label) AS own, max(sim) FILTER (p_label <> label) AS rival, arg_max(p_label, sim) FILTER (p_label <> label) AS rival_label FROM sims GROUP BY vec_id, label)"""
)


@query("q_prototype_margin", f"WITH {_MARGIN_SQL} SELECT vec_id, label, round(own, 6) + 0.0 AS own, round(rival, 6) + 0.0 AS rival, rival_label, round(own - rival, 6) + 0.0 AS margin FROM m")
def q_prototype_margin(table):
    """Own and nearest rival prototype of each vector."""
    return _margins(table).select("vec_id", "label", r("own").alias("own"), r("rival").alias("rival"), "rival_label", r("margin").alias("margin"))


_SHELL_SQL = (
    _MARGIN_SQL
    + """,
k AS (SELECT *, round(own - rival, 9) AS mg, round(own, 9) AS o, round(rival, 9) AS rv FROM m),
q AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY o, vec_id) - 1) / CAST(greatest(count(*) OVER (PARTITION BY label) - 1, 1) AS DOUBLE) AS pct FROM k),
sel AS (SELECT label, 'centroid' AS selector, vec_id, row_number() OVER (PARTITION BY label ORDER BY o DESC, vec_id) AS n FROM q
UNION ALL SELECT label, 'rival_edge', vec_id, row_number() OVER (PARTITION BY label ORDER BY rv DESC, vec_id) FROM q WHERE pct BETWEEN 0.05 AND 0.3
UNION ALL SELECT label, 'outward_edge', vec_id, row_number() OVER (PARTITION BY label ORDER BY rv, vec_id) FROM q WHERE pct BETWEEN 0.05 AND 0.3
UNION ALL SELECT label, 'high_margin', vec_id, row_number() OVER (PARTITION BY label ORDER BY mg DESC, vec_id) FROM q WHERE pct BETWEEN 0.05 AND 0.3
UNION ALL SELECT label, 'hash_random', vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('7' || chr(0) || CAST(vec_id AS VARCHAR))) FROM q WHERE pct BETWEEN 0.05 AND 0.3)
SELECT label, selector, vec_id FROM sel WHERE n = 1"""
)


@query("q_geometry", f"WITH {_SHELL_SQL}")
def q_geometry(table):
    """One vector for each label and selector (C10, C12, P5, W2, W7, W18): the most central, and four from a shell of the
    distance order. A radius percentile of 0.70 to 0.95 is an own-similarity percentile of 0.05 to 0.30."""
    m = _margins(table).select("vec_id", "label", F.round("own", 9).alias("o"), F.round("rival", 9).alias("rv"), F.round("margin", 9).alias("mg"))
    q = m.withColumn("pct", op.ordinal_percentile("o", "vec_id", "label"))
    shell = F.col("pct").between(0.05, 0.3)
    inside = F.when(shell, 0).otherwise(1)
    key = fn.sampling_key(F.lit(7), F.col("vec_id"))
    orders = {"centroid": (F.lit(0), -F.col("o")), "rival_edge": (inside, -F.col("rv")), "outward_edge": (inside, F.col("rv")), "high_margin": (inside, -F.col("mg")), "hash_random": (inside, key)}
    # each selector is one struct minimum: five choices in one map-side combined aggregation
    best = q.groupBy("label").agg(*(F.min(F.struct(a.alias("out"), b.alias("v"), F.col("vec_id"))).alias(name) for name, (a, b) in orders.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("selector"), F.col(f"{n}.vec_id").alias("vec_id"), F.col(f"{n}.out").alias("out")) for n in orders)))
    return best.select("label", rows.alias("x")).where("x.out = 0").select("label", "x.selector", "x.vec_id")


_KNN_SQL = f"WITH {UNIT_SQL}, n AS (SELECT a.vec_id, b.vec_id AS neighbour, a.label = b.label AS same, list_dot_product(a.unit, b.unit) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.unit, b.unit), 9) DESC, b.vec_id) AS rank FROM u a JOIN u b ON a.vec_id <> b.vec_id"


@query("q_knn", _KNN_SQL + ") SELECT vec_id, neighbour, CAST(rank AS INT) AS rank, round(sim, 6) + 0.0 AS sim FROM n WHERE rank <= 10")
def q_knn(table):
    """Exact nearest neighbours by blocks."""
    return op.blocked_neighbours(unit_vectors(table), 10).select("vec_id", "neighbour", "rank", r("sim").alias("sim"))


@query("q_within_class_knn", _KNN_SQL + " AND a.label = b.label) SELECT vec_id, round(avg(1 - sim), 6) + 0.0 AS mean_distance FROM n WHERE rank <= 5 GROUP BY vec_id")
def q_within_class_knn(table):
    """Mean distance to the nearest of the own label."""
    near = op.blocked_neighbours(unit_vectors(table), 5, within="label")
    return near.groupBy("vec_id").agg(r(F.avg(1 - F.col("sim"))).alias("mean_distance"))


@query("q_knn_interclass_ratio", _KNN_SQL + ") SELECT label, round(avg(CASE WHEN same THEN 0.0 ELSE 1.0 END), 6) + 0.0 AS other_share FROM n JOIN u USING (vec_id) WHERE rank <= 10 GROUP BY label")
def q_knn_interclass_ratio(table):
    """Share of other labels among the nearest."""
    unit = unit_vectors(table)
    near = op.blocked_neighbours(unit, 10)
    labels = unit.select(F.col("vec_id").alias("id2"), F.col("label").alias("label2"))
    both = near.join(unit.select("vec_id", "label"), "vec_id").join(labels, F.col("neighbour") == F.col("id2"))
    return both.groupBy("label").agg(r(F.avg(F.when(F.col("label") == F.col("label2"), 0.0).otherwise(1.0))).alias("other_share"))


@query("q_hash_sample", "SELECT label, vec_id, CAST(n - 1 AS INT) AS slot FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('3' || chr(0) || CAST(vec_id AS VARCHAR))) AS n FROM embeddings) WHERE n <= 5")
def q_hash_sample(table):
    """A draw per label that depends on identity alone."""
    return op.top_per_group(table("embeddings"), 5, "label", fn.sampling_key(F.lit(3), F.col("vec_id"))).select("label", "vec_id", "slot")


_DRAW_SQL = "{name} AS (SELECT label, list(vec_id ORDER BY n) AS {name} FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('3' || chr(0) || CAST(vec_id AS VARCHAR))) AS n FROM embeddings) WHERE n <= {k} GROUP BY label)"


@query(
    "q_nested_prefix",
    f"WITH {', '.join(_DRAW_SQL.format(name=f'd{k}', k=k) for k in (3, 5, 10, 20))} SELECT label, d3 = d5[1:3] AS three_in_five, d5 = d10[1:5] AS five_in_ten, d10 = d20[1:10] AS ten_in_twenty FROM d3 JOIN d5 USING (label) JOIN d10 USING (label) JOIN d20 USING (label)",
)
def q_nested_prefix(table):
    """Four draws of each label, each on its own: a smaller one is the start of the next larger."""

    def draw(k: int):
        chosen = op.top_per_group(table("embeddings").where("label is not null"), k, "label", fn.sampling_key(F.lit(3), F.col("vec_id")))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("slot", "vec_id"))), lambda s: s["vec_id"])
        return chosen.groupBy("label").agg(listed.alias(f"d{k}"))

    both = draw(3).join(draw(5), "label").join(draw(10), "label").join(draw(20), "label")
    starts = lambda a, b, name: (F.col(f"d{a}") == F.slice(f"d{b}", 1, a)).alias(name)
    return both.select("label", starts(3, 5, "three_in_five"), starts(5, 10, "five_in_ten"), starts(10, 20, "ten_in_twenty"))


@query("q_stratified_folds", "SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY sha256('5' || chr(0) || CAST(vec_id AS VARCHAR))) - 1) % 5 AS INT) AS fold FROM embeddings")
def q_stratified_folds(table):
    """Five folds, balanced within labels."""
    return table("embeddings").select("vec_id", "label", op.hash_fold("label", 5, "vec_id", 5).alias("fold"))


@query("q_balanced_chunks", "SELECT vec_id, label, CAST(ntile(4) OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS chunk FROM embeddings")
def q_balanced_chunks(table):
    """Chunks of near-equal size, the first larger."""
    return table("embeddings").select("vec_id", "label", (F.ntile(4).over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("chunk"))


_SEED_SQL = "CAST(('0x' || substring(h, 15, 2) || substring(h, 13, 2) || substring(h, 11, 2) || substring(h, 9, 2) || substring(h, 7, 2) || substring(h, 5, 2) || substring(h, 3, 2) || substring(h, 1, 2)) AS UBIGINT) & CAST(9223372036854775807 AS UBIGINT)"


@query(
    "q_gumbel_topk",
    f"""WITH d AS (SELECT doc_id, lang, n_chars, sha256('11' || chr(0) || CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE n_chars IS NOT NULL),
p AS (SELECT *, (rank() OVER (PARTITION BY lang ORDER BY n_chars) - 1 + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0) / greatest(count(*) OVER (PARTITION BY lang) - 1, 1) AS pct, (CAST({_SEED_SQL} AS DOUBLE) + 0.5) / 9223372036854775808.0 AS u FROM d),
s AS (SELECT doc_id, lang, 2.0 * (2.0 * pct - 1.0) - ln(-ln(u)) AS score FROM p)
SELECT lang, doc_id, round(score, 6) + 0.0 AS score, CAST(n - 1 AS INT) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, doc_id) AS n FROM s) WHERE n <= 10""",
)
def q_gumbel_topk(table):
    """A biased draw: the rank's pull plus the identity's own noise."""
    d = table("documents").where("n_chars is not null").withColumn("pct", op.average_tie_percentile("n_chars", "lang"))
    d = d.withColumn("score", 2.0 * (2.0 * F.col("pct") - 1.0) + fn.gumbel(F.lit(11), F.col("doc_id")))
    return op.top_per_group(d, 10, "lang", F.desc(F.round("score", 9)), F.col("doc_id")).select("lang", "doc_id", r("score").alias("score"), "slot")


_LOGITS = PROTO_SQL + ", l AS (SELECT vec_id, label, list(sim / 0.1 ORDER BY p_label) AS z FROM sims GROUP BY vec_id, label), x AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS ex FROM l), f AS (SELECT vec_id, label, list_transform(ex, lambda v: v / list_sum(ex)) AS p FROM x)"


def soft_labels(table):
    """Synthetic soft labels: the softmax of each vector's similarities to the prototypes over 0.1."""
    unit = unit_vectors(table)
    protos = op.prototypes(unit).select(F.col("label").alias("p_label"), "proto")
    sims = unit.join(protos).select("vec_id", "label", "p_label", (fn.dot(F.col("unit"), F.col("proto")) / 0.1).alias("z"))
    z = sims.groupBy("vec_id", "label").agg(F.array_sort(F.collect_list(F.struct("p_label", "z"))).alias("s"))
    return z.select("vec_id", "label", fn.softmax(F.transform("s", lambda s: s["z"])).alias("p"))


_ENTROPY = "-list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END))"


@query("q_softlabel_profile", f"WITH {_LOGITS} SELECT vec_id, round({_ENTROPY}, 6) + 0.0 AS entropy, round(exp({_ENTROPY}), 6) AS effective, round(p[label + 1], 6) AS target_p, round(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2], 6) + 0.0 AS margin, list_position(p, list_max(p)) - 1 = label AS matched FROM f")
def q_softlabel_profile(table):
    """Entropy, effective classes, target probability, margin, match."""
    p = F.col("p")
    top = F.sort_array("p", asc=False)
    h = fn.entropy(p)
    return soft_labels(table).select("vec_id", r(h).alias("entropy"), F.round(F.exp(h), 6).alias("effective"), F.round(F.element_at(p, F.col("label") + 1), 6).alias("target_p"), r(top[0] - top[1]).alias("margin"), (fn.first_arg_max(p) == F.col("label")).alias("matched"))


@query("q_nontarget_shape", f"WITH {_LOGITS}, o AS (SELECT vec_id, list_concat(p[1:label], p[label + 2:]) AS q FROM f), n AS (SELECT vec_id, list_transform(q, lambda v: v / list_sum(q)) AS p FROM o) SELECT vec_id, round(exp({_ENTROPY}), 6) AS effective, round(list_max(p), 6) AS top_share FROM n")
def q_nontarget_shape(table):
    """The distribution over the other classes."""
    d = soft_labels(table).select("vec_id", fn.others(F.col("p"), F.col("label")).alias("q"))
    return d.select("vec_id", F.round(F.exp(fn.entropy(F.col("q"))), 6).alias("effective"), F.round(F.array_max("q"), 6).alias("top_share"))


@query("q_keep_topk", f"WITH {_LOGITS}, t AS (SELECT vec_id, p, list_sort(p, 'DESC') AS s FROM f) SELECT vec_id, round(list_sum(s[1:3]), 6) AS kept, round((1 - list_sum(s[1:3])) / 7, 6) AS rest_share, 1.0 AS mass FROM t")
def q_keep_topk(table):
    """Three largest kept, the rest smoothed; the mass stays."""
    d = soft_labels(table).select("vec_id", fn.keep_top(F.col("p"), 3).alias("k"))
    s = F.sort_array("k", asc=False)
    return d.select("vec_id", F.round(s[0] + s[1] + s[2], 6).alias("kept"), F.round(F.array_min("k"), 6).alias("rest_share"), F.round(fn.total(F.col("k")), 6).alias("mass"))


@query("q_marginalise", f"WITH {_LOGITS} SELECT vec_id, round(p[1] + p[3] + p[5] + p[7] + p[9], 6) AS even, round(p[2] + p[4] + p[6] + p[8] + p[10], 6) AS odd FROM f")
def q_marginalise(table):
    """Fine probabilities summed by parent (L1)."""
    m = fn.marginalised(F.col("p"), [k % 2 for k in range(10)])
    return soft_labels(table).select("vec_id", m.alias("m")).select("vec_id", F.round(F.col("m")[0], 6).alias("even"), F.round(F.col("m")[1], 6).alias("odd"))


@query("q_order_template", f"WITH {_LOGITS}, o AS (SELECT vec_id, label, v, i - 1 AS i FROM (SELECT vec_id, label, unnest(p) AS v, unnest(range(1, 11)) AS i FROM f)) SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY round(v, 12) DESC, i) AS others FROM o WHERE i <> label GROUP BY vec_id")
def q_order_template(table):
    """Other classes by falling probability."""
    p = F.transform("p", lambda v: F.round(v, 12))
    return soft_labels(table).select("vec_id", F.array_join(F.transform(fn.order_of_others(p, F.col("label")), lambda i: i.cast("string")), ",").alias("others"))


@query("q_confusion", f"WITH {PROTO_SQL}, b AS (SELECT vec_id, label, arg_max(p_label, sim) AS pred FROM sims GROUP BY vec_id, label) SELECT label, pred, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY label) AS DOUBLE), 6) AS share FROM b GROUP BY label, pred")
def q_confusion(table):
    """Nearest-prototype confusion with row shares."""
    m = _margins(table).withColumn("pred", F.when(F.col("own") >= F.col("rival"), F.col("label")).otherwise(F.col("rival_label")))
    n = m.groupBy("label", "pred").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")).cast("double"), 6))


@query("q_prf1", f"WITH {PROTO_SQL}, b AS (SELECT vec_id, label, arg_max(p_label, sim) AS pred FROM sims GROUP BY vec_id, label), t AS (SELECT label, sum((pred = label)::INT) AS tp, count(*) AS n FROM b GROUP BY label), q AS (SELECT pred, count(*) AS m FROM b GROUP BY pred) SELECT label, round(coalesce(tp / m, 0), 6) + 0.0 AS precision_, round(tp / n, 6) + 0.0 AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (n + coalesce(m, 0)) END, 6) + 0.0 AS f1 FROM t LEFT JOIN q ON pred = label")
def q_prf1(table):
    """Precision, recall and F1, undefined ones as 0."""
    m = _margins(table).withColumn("pred", F.when(F.col("own") >= F.col("rival"), F.col("label")).otherwise(F.col("rival_label")))
    ends = F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("n"), F.lit(0).alias("m")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("n"), F.lit(1).alias("m"))))
    hit = (F.col("label") == F.col("pred")).cast("int")
    s = m.select(hit.alias("hit"), ends.alias("x")).groupBy("x.c").agg(F.sum("x.n").alias("n"), F.sum("x.m").alias("m"), (F.sum("hit") / 2.0).alias("tp"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b.cast("double")), F.lit(0.0))
    return s.select(F.col("c").alias("label"), r(safe(F.col("tp"), F.col("m"))).alias("precision_"), r(safe(F.col("tp"), F.col("n"))).alias("recall"), r(safe(2.0 * F.col("tp"), F.col("n") + F.col("m"))).alias("f1"))


@query("q_topk_accuracy", f"WITH {PROTO_SQL}, k AS (SELECT vec_id, label, p_label, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, p_label) AS n FROM sims) SELECT label, round(avg((n <= 1)::INT), 6) AS top1, round(avg((n <= 3)::INT), 6) AS top3 FROM k WHERE label = p_label GROUP BY label")
def q_topk_accuracy(table):
    """Is the target among the first k?"""
    at = F.array_position(F.transform(F.array_sort(F.transform("p", lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), lambda s: s["i"]), F.col("label"))
    d = soft_labels(table).select("label", at.alias("n"))
    return d.groupBy("label").agg(F.round(F.avg((F.col("n") <= 1).cast("int")), 6).alias("top1"), F.round(F.avg((F.col("n") <= 3).cast("int")), 6).alias("top3"))


@query("q_ece", f"WITH {_LOGITS}, c AS (SELECT list_max(p) AS conf, (list_position(p, list_max(p)) - 1 = label)::INT AS ok FROM f), b AS (SELECT least(CAST(floor(conf * 15) AS INT), 14) AS bin, count(*) AS n, avg(conf) AS conf, avg(ok) AS acc FROM c GROUP BY 1) SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM b")
def q_ece(table):
    """Expected calibration error over 15 bins, the last one closed."""
    c = soft_labels(table).select(F.array_max("p").alias("conf"), (fn.first_arg_max(F.col("p")) == F.col("label")).cast("int").alias("ok"))
    b = c.groupBy(F.least(F.floor(F.col("conf") * 15), F.lit(14)).alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg("ok").alias("acc"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 6).alias("ece"))


@query("q_inception_score", f"WITH {_LOGITS}, m AS (SELECT i, avg(p[i]) AS q FROM f, range(1, 11) AS t(i) GROUP BY i) SELECT round(exp((SELECT -sum(q * ln(q)) FROM m) - (SELECT avg({_ENTROPY}) FROM f)), 6) AS score")
def q_inception_score(table):
    """exp of the marginal's entropy less the mean entropy."""
    d = soft_labels(table)
    marginal = d.select(F.posexplode("p").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("q")).agg((-F.sum(F.col("q") * F.log("q"))).alias("h"))
    mean = d.agg(F.avg(fn.entropy(F.col("p"))).alias("g"))
    return marginal.join(mean).select(F.round(F.exp(F.col("h") - F.col("g")), 6).alias("score"))


@query("q_variance_ratio", f"WITH {_LOGITS}, y AS (SELECT vec_id, label, i, p[i] AS v FROM f, range(1, 11) AS t(i)), c AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM y GROUP BY label, i), h AS (SELECT i, avg(v) AS m FROM y GROUP BY i) SELECT round((SELECT sum((v - m) * (v - m)) FROM y JOIN c USING (label, i)) / (SELECT sum(n * (c.m - h.m) * (c.m - h.m)) FROM c JOIN h USING (i)), 6) AS ratio")
def q_variance_ratio(table):
    """Trace of the variance within labels over that between (M16), from sums alone."""
    x = soft_labels(table).select("label", F.posexplode("p").alias("i", "v"))
    c = x.groupBy("label", "i").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.var_pop("v").alias("var"))
    within = c.agg(F.sum(F.col("n") * F.col("var")).alias("within"))
    between = c.groupBy("i").agg((F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("b")).agg(F.sum("b").alias("between"))
    return within.join(between).select(F.round(F.col("within") / F.col("between"), 6).alias("ratio"))


@query("q_participation_rank", f"WITH {UNIT_SQL}, x AS (SELECT i, j, sum(unit[i] * unit[j]) AS g FROM u, range(1, 65) AS a(i), range(1, 65) AS b(j) GROUP BY i, j) SELECT round((SELECT sum(g) FROM x WHERE i = j) * (SELECT sum(g) FROM x WHERE i = j) / (SELECT sum(g * g) FROM x), 4) AS rank")
def q_participation_rank(table):
    """Squared trace over the trace of the square of the Gram matrix of dimensions."""
    e = unit_vectors(table).select("vec_id", F.posexplode("unit").alias("i", "v"))
    g = e.join(e.select("vec_id", F.col("i").alias("j"), F.col("v").alias("w")), "vec_id").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("g"))
    t = F.sum(F.when(F.col("i") == F.col("j"), F.col("g")))
    return g.agg(F.round(t * t / F.sum(F.col("g") * F.col("g")), 4).alias("rank"))


@query("q_coverage", f"WITH {UNIT_SQL}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('3' || chr(0) || CAST(vec_id AS VARCHAR))) AS n FROM u) WHERE n <= 3), b AS (SELECT u.vec_id, u.label, max(list_dot_product(u.unit, c.unit)) AS s FROM u JOIN c ON c.label = u.label GROUP BY u.vec_id, u.label) SELECT label, round(avg(1 - s), 6) + 0.0 AS mean_distance, round(avg(s), 6) + 0.0 AS utility FROM b GROUP BY label")
def q_coverage(table):
    """How near a selection of three a label comes to all its vectors."""
    unit = unit_vectors(table)
    chosen = op.top_per_group(unit, 3, "label", fn.sampling_key(F.lit(3), F.col("vec_id"))).select(F.col("label").alias("c_label"), F.col("unit").alias("c"))
    near = unit.join(chosen, F.col("label") == F.col("c_label")).groupBy("vec_id", "label").agg(F.max(fn.dot(F.col("unit"), F.col("c"))).alias("s"))
    return near.groupBy("label").agg(r(F.avg(1 - F.col("s"))).alias("mean_distance"), r(F.avg("s")).alias("utility"))


@query("q_kmeans_spherical")
def q_kmeans_spherical(table):
    """Clusters within labels (C1); checked by invariants."""
    return op.spherical_kmeans(unit_vectors(table), 3)


@query("q_facility_greedy")
def q_facility_greedy(table):
    """Greedy facility location (C14); checked by its rising utility and against brute force."""
    return op.greedy_facility(unit_vectors(table), 3).withColumn("utility", r("utility"))


@query("q_joint_facility")
def q_joint_facility(table):
    """One vector of each of three sources a label, chosen together and exchanged until none does better (C14); tested against exchanges."""
    d = unit_vectors(table).withColumn("source", F.col("vec_id") % 3)
    return op.joint_facility(d, "source").withColumn("utility", r("utility"))


@query("q_two_means")
def q_two_means(table):
    """Two clusters a label from hash-keyed starts, by their nearest vectors (C4); tested as fixed points of Lloyd's step and against all starts."""
    return op.two_means(unit_vectors(table), 20260914).withColumn("sim", r("sim"))


@query(
    "q_global_centre_top",
    f"""WITH {UNIT_SQL}, c AS (SELECT label, i, sum(unit[i]) AS x FROM u, range(1, 65) AS t(i) GROUP BY ALL), n AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY label),
    d AS (SELECT u.label, vec_id, round(list_dot_product(unit, v) / sqrt(list_dot_product(v, v)), 9) AS sim FROM u JOIN n ON n.label = u.label)
    SELECT label, vec_id, CAST(k - 1 AS INT) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS k FROM d) WHERE k <= 3""",
)
def q_global_centre_top(table):
    """The three vectors nearest to each label's centre."""
    unit = unit_vectors(table)
    sims = op.margins(unit, op.prototypes(unit)).withColumn("own", F.round("own", 9))
    return op.top_per_group(sims, 3, "label", F.desc("own"), F.col("vec_id")).select("label", "vec_id", "slot")
