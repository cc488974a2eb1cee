"""Selections compared, contracts checked, schedules and scalar rules, on the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from .geometry import _LOGITS, soft_labels
from .registry import UNIT_SQL, query, r, unit_vectors

_DRAW = "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('{0}' || chr(0) || CAST(vec_id AS VARCHAR))) AS n FROM embeddings"


def _draw(table, seed: int, k: int):
    return op.top_per_group(table("embeddings"), k, "label", fn.sampling_key(F.lit(seed), F.col("vec_id"))).select("label", "vec_id", "slot")


@query("q_selection_overlap", f"WITH a AS (SELECT label, vec_id FROM ({_DRAW.format(3)}) WHERE n <= 20), b AS (SELECT label, vec_id FROM ({_DRAW.format(4)}) WHERE n <= 20), l AS (SELECT a.label, count(b.vec_id) / CAST(count(*) AS DOUBLE) AS share FROM a LEFT JOIN b ON a.vec_id = b.vec_id GROUP BY a.label) SELECT round(avg(share), 6) AS mean, round(min(share), 6) AS least, round(max(share), 6) AS largest FROM l")
def q_selection_overlap(table):
    """Shared part of two selections over labels."""
    b = _draw(table, 4, 20).select("vec_id", F.lit(1).alias("hit"))
    l = _draw(table, 3, 20).join(b, "vec_id", "left").groupBy("label").agg((F.count("hit") / F.count("*").cast("double")).alias("share"))
    return l.agg(F.round(F.avg("share"), 6).alias("mean"), F.round(F.min("share"), 6).alias("least"), F.round(F.max("share"), 6).alias("largest"))


_NEAR = "{0} AS (SELECT vec_id, list(nb) AS l FROM (SELECT a.vec_id, b.vec_id AS nb, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product({1}), 9) DESC, b.vec_id) AS k FROM u a JOIN u b ON a.vec_id <> b.vec_id) WHERE k <= 5 GROUP BY vec_id)"


@query("q_neighbour_jaccard", f"WITH {UNIT_SQL}, {_NEAR.format('whole', 'a.unit, b.unit')}, {_NEAR.format('part', 'a.unit[1:16], b.unit[1:16]')} SELECT round(avg(len(list_intersect(w.l, p.l)) / CAST(len(list_distinct(list_concat(w.l, p.l))) AS DOUBLE)), 6) AS jaccard FROM whole w JOIN part p USING (vec_id)")
def q_neighbour_jaccard(table):
    """How far neighbours in a quarter of the dimensions are the neighbours in all."""
    unit = unit_vectors(table)
    sets = lambda d, name: op.blocked_neighbours(d, 5).groupBy("vec_id").agg(F.collect_list("neighbour").alias(name))
    both = sets(unit, "a").join(sets(unit.withColumn("unit", F.slice("unit", 1, 16)), "b"), "vec_id")
    return both.agg(F.round(F.avg(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))), 6).alias("jaccard"))


_BOX = "SELECT l_returnflag AS variant, l_quantity AS w, least(l_quantity, 25 + l_linenumber) / greatest(l_quantity, 25 + l_linenumber) AS iou FROM lineitem"


@query("q_recall_thresholds", f"SELECT variant, round(avg((coalesce(iou, 0) >= 0.5)::INT), 6) AS r50, round(avg((coalesce(iou, 0) >= 0.75)::INT), 6) AS r75, round(avg((coalesce(iou, 0) >= 0.9)::INT), 6) AS r90 FROM ({_BOX}) GROUP BY variant")
def q_recall_thresholds(table):
    """Recall of boxes [0, w] against [0, 25 + line] at three overlaps, missing ones as misses."""
    zero, one = F.lit(0.0), F.lit(1.0)
    iou = fn.box_iou([zero, zero, F.col("l_quantity"), one], [zero, zero, F.col("l_linenumber") + 25.0, one])
    d = table("lineitem").select(F.col("l_returnflag").alias("variant"), F.coalesce(iou, zero).alias("iou"))
    return d.groupBy("variant").agg(*(F.round(F.avg((F.col("iou") >= t).cast("int")), 6).alias(f"r{round(t * 100)}") for t in (0.5, 0.75, 0.9)))


@query("q_balance_contract", "WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT min(n) AS least, max(n) AS largest, max(n) = min(n) AS equal_, max(n) - min(n) <= 1 AS near_equal FROM g")
def q_balance_contract(table):
    """Are all groups of one size, or within one of it?"""
    g = table("embeddings").groupBy("label").agg(F.count("*").alias("n"))
    a, b = F.min("n"), F.max("n")
    return g.agg(a.alias("least"), b.alias("largest"), (a == b).alias("equal_"), (b - a <= 1).alias("near_equal"))


@query("q_parameter_change", "WITH d AS (SELECT l_quantity AS a, l_quantity * (1 + l_tax / 10) AS b FROM lineitem) SELECT round(sqrt(sum((a - b) * (a - b)) / sum(a * a)), 8) AS relative_l2, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 8) AS cosine, round(max(abs(a - b)), 6) AS largest, count(*) FILTER (a <> b) AS unequal FROM d")
def q_parameter_change(table):
    """Two parameter sets in one pass (A45); the largest change and how many differ."""
    d = table("lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_quantity") * (1 + F.col("l_tax") / 10)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return d.agg(F.round(F.sqrt(F.sum((a - b) * (a - b)) / F.sum(a * a)), 8).alias("relative_l2"), F.round(F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b)), 8).alias("cosine"), F.round(F.max(F.abs(a - b)), 6).alias("largest"), F.count_if(a != b).alias("unequal"))


@query("q_moving_centre", "WITH RECURSIVE d AS (SELECT event_type, CAST(hour(ts) AS INT) AS step, avg(value) AS v FROM events GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY step) AS k FROM d), c AS (SELECT event_type, k, v AS centre FROM o WHERE k = 1 UNION ALL SELECT o.event_type, o.k, 0.9 * c.centre + 0.1 * o.v FROM c JOIN o ON o.event_type = c.event_type AND o.k = c.k + 1) SELECT event_type, count(*) AS steps, round(max_by(centre, k), 6) + 0.0 AS centre FROM c GROUP BY event_type")
def q_moving_centre(table):
    """Exponential moving centre over batches, each batch at its mean (A47). Batches are aggregated first: the fold runs over steps."""
    d = table("events").groupBy("event_type", F.hour("ts").alias("step")).agg(F.avg("value").alias("v"))
    s = d.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "v"))), lambda x: x["v"]).alias("v"))
    centre = F.aggregate(F.slice("v", 2, 1 << 30), F.col("v")[0], lambda a, x: 0.9 * a + 0.1 * x)
    return s.select("event_type", F.size("v").cast("long").alias("steps"), r(centre).alias("centre"))


@query("q_scaling_steps", "WITH s AS (SELECT l_linestatus AS seed, CAST(l_linenumber AS INT) AS level, avg(l_extendedprice) AS v FROM lineitem WHERE l_linenumber IN (1, 2, 4) GROUP BY 1, 2) SELECT a.seed, a.level AS low, b.level AS high, round(b.v - a.v, 4) + 0.0 AS gain FROM s a JOIN s b ON a.seed = b.seed AND a.level < b.level")
def q_scaling_steps(table):
    """Gains between all levels of a scale, by seed."""
    s = table("lineitem").where("l_linenumber in (1, 2, 4)").groupBy(F.col("l_linestatus").alias("seed"), F.col("l_linenumber").cast("int").alias("level")).agg(F.avg("l_extendedprice").alias("v"))
    a, b = s.select("seed", F.col("level").alias("low"), F.col("v").alias("a")), s.select("seed", F.col("level").alias("high"), F.col("v").alias("b"))
    return a.join(b, "seed").where("low < high").select("seed", "low", "high", r(F.col("b") - F.col("a"), 4).alias("gain"))


@query("q_metric_columns", "SELECT l_returnflag, metric, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd FROM (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR metric IN (l_quantity, l_discount, l_tax)) GROUP BY 1, 2")
def q_metric_columns(table):
    """The same summary of many metric columns."""
    long = table("lineitem").unpivot(["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "metric", "v")
    return long.groupBy("l_returnflag", "metric").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("sd"))


@query("q_predicates", "SELECT count(*) FILTER (o_totalprice / 5000 BETWEEN 0 AND 100) AS in_range, count(*) FILTER (abs(o_totalprice - round(o_totalprice, 1)) <= 1e-8) AS near_tenth, count(*) FILTER (o_orderkey % 4 = 1) AS shard, count(*) FILTER (o_orderkey % 100 >= 80 AND (o_orderkey % 10 = 9 OR o_orderkey % 100 = 99)) AS special, count(*) FILTER (CASE WHEN o_orderkey % 100 < 20 THEN 'early' WHEN o_orderkey % 100 BETWEEN 40 AND 60 THEN 'middle' WHEN o_orderkey % 100 >= 80 THEN 'late' END IS NULL) AS between_ FROM orders")
def q_predicates(table):
    """Ranges, tolerances, shards, special epochs, gaps between buckets (P6, P10, P11, P13, P14) in one scan."""
    e = F.col("o_orderkey") % 100
    bucket = F.when(e < 20, "early").when(e.between(40, 60), "middle").when(e >= 80, "late")
    return table("orders").agg(
        F.count_if((F.col("o_totalprice") / 5000).between(0, 100)).alias("in_range"),
        F.count_if(fn.same(F.col("o_totalprice"), F.round("o_totalprice", 1), 1e-8)).alias("near_tenth"),
        F.count_if(F.pmod("o_orderkey", F.lit(4)) == 1).alias("shard"),
        F.count_if((e >= 80) & ((e % 10 == 9) | (e == 99))).alias("special"),
        F.count_if(bucket.isNull()).alias("between_"),
    )


@query("q_tags", f"WITH a AS ({_DRAW.format(3)}), b AS ({_DRAW.format(4)}), t AS (SELECT vec_id, 'third' AS tag FROM a WHERE n <= 5 UNION ALL SELECT vec_id, 'fourth' FROM b WHERE n <= 5) SELECT vec_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM t GROUP BY vec_id")
def q_tags(table):
    """Which selectors took a row."""
    t = _draw(table, 3, 5).select("vec_id", F.lit("third").alias("tag")).unionByName(_draw(table, 4, 5).select("vec_id", F.lit("fourth").alias("tag")))
    return t.groupBy("vec_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))


@query("q_feature_store_audit", "SELECT count(DISTINCT label) AS classes, count(*) - count(DISTINCT vec_id) AS repeated, count(*) FILTER (len(embedding) <> 64) AS wrong_width, count(*) FILTER (embedding IS NULL OR len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) > 0) AS not_finite FROM embeddings")
def q_feature_store_audit(table):
    """Classes, repeated keys, width and finiteness of a feature store (Q11, Q4)."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return table("embeddings").agg(F.count_distinct("label").alias("classes"), (F.count("*") - F.count_distinct("vec_id")).alias("repeated"), F.count_if(F.size("embedding") != 64).alias("wrong_width"), F.count_if(F.coalesce(bad, F.lit(True))).alias("not_finite"))


@query("q_status_counts", "SELECT count(*) FILTER (o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus = 'O') AS running, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other, count(*) FILTER (o_orderstatus <> 'F') = 0 AS done FROM orders")
def q_status_counts(table):
    """Is every run complete? (Q12)"""
    s = F.col("o_orderstatus")
    return table("orders").agg(F.count_if(s == "F").alias("complete"), F.count_if(s == "O").alias("running"), F.count_if(~s.isin("F", "O")).alias("other"), (F.count_if(s != "F") == 0).alias("done"))


@query("q_contiguous_ids", "SELECT count(*) FILTER (NOT regexp_full_match(p_name, '.*[a-z].*')) AS odd_names, max(p_partkey) - min(p_partkey) + 1 = count(DISTINCT p_partkey) AS contiguous FROM part")
def q_contiguous_ids(table):
    """Names by pattern, identifiers without gaps (Q13)."""
    return table("part").agg(F.count_if(~F.col("p_name").rlike("[a-z]")).alias("odd_names"), (F.max("p_partkey") - F.min("p_partkey") + 1 == F.count_distinct("p_partkey")).alias("contiguous"))


@query("q_lineage", f"WITH {_LOGITS}, d AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('3' || chr(0) || CAST(vec_id AS VARCHAR))) AS n, list_max(p) AS top FROM f) SELECT vec_id, label, round(top, 6) AS membership, CASE WHEN n <= 3 THEN 'retained' WHEN top < 0.5 THEN 'noise' ELSE 'pruned' END AS disposition, CASE WHEN n <= 3 THEN CAST(n - 1 AS INT) END AS slot FROM d")
def q_lineage(table):
    """One row a source: membership, what became of it, its slot."""
    n = F.row_number().over(Window.partitionBy("label").orderBy(fn.sampling_key(F.lit(3), F.col("vec_id"))))
    d = soft_labels(table).select("vec_id", "label", F.array_max("p").alias("top")).withColumn("n", n)
    kept = F.col("n") <= 3
    return d.select("vec_id", "label", F.round("top", 6).alias("membership"), F.when(kept, "retained").when(F.col("top") < 0.5, "noise").otherwise("pruned").alias("disposition"), F.when(kept, F.col("n") - 1).alias("slot"))


@query("q_manifest_join", "SELECT o.o_orderstatus, count(*) AS runs, count(DISTINCT c.c_mktsegment) = 1 AS one_manifest, count(*) FILTER (c.c_custkey IS NULL) AS missing FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1")
def q_manifest_join(table):
    """Runs joined to their manifests, which must be one and present."""
    c = table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    j = table("orders").select("o_custkey", "o_orderstatus").join(c, "o_custkey", "left")
    return j.groupBy("o_orderstatus").agg(F.count("*").alias("runs"), (F.count_distinct("c_mktsegment") == 1).alias("one_manifest"), F.count_if(F.col("c_mktsegment").isNull()).alias("missing"))


@query("q_even_sample", "WITH k AS (SELECT DISTINCT CAST(round_even(i * 99 / 6.0, 0) AS INT) AS place FROM range(7) AS t(i)) SELECT label, place, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings) JOIN k ON n = place")
def q_even_sample(table):
    """Seven evenly spaced places of an axis, halves to the even (W23): a sampling operator."""
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.bround(i * 99 / 6.0, 0).cast("int")))
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table("embeddings").withColumn("place", n).where(F.array_contains(at, F.col("place"))).select("label", "place", "vec_id")


@query(
    "q_learning_rates",
    """WITH s AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT event_id, round(1e-5 + 0.5 * (0.01 - 1e-5) * (1 + cos(pi() * i / n)), 9) AS cosine, CASE WHEN i * 3 < n * 2 THEN 1e-2 WHEN i * 6 < n * 5 THEN 2e-3 ELSE 4e-4 END AS stepped FROM s""",
)
def q_learning_rates(table):
    """The cosine and the stepped learning rate of each update of each user's series."""
    by = Window.partitionBy("user_id")
    s = table("events").select("event_id", (F.row_number().over(by.orderBy("ts", "event_id")) - 1).alias("i"), F.count("*").over(by).alias("n"))
    i, n = F.col("i"), F.col("n")
    stepped = F.when(i * 3 < n * 2, 1e-2).when(i * 6 < n * 5, 2e-3).otherwise(4e-4)
    return s.select("event_id", F.round(1e-5 + 0.5 * (0.01 - 1e-5) * (1 + F.cos(F.pi() * i / n)), 9).alias("cosine"), stepped.alias("stepped"))


@query("q_signal_errors", "WITH e AS (SELECT label, embedding[1] AS a, embedding[2] AS b FROM embeddings) SELECT label, round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, round(10 * log10(1 / avg((a - b) * (a - b))), 5) AS psnr FROM (SELECT label, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM e) GROUP BY label")
def q_signal_errors(table):
    """Mean and squared errors, and their ratio to the peak in decibels."""
    e = table("embeddings").select("label", (F.col("embedding")[0].cast("double") - F.col("embedding")[1].cast("double")).alias("d"))
    mse = F.avg(F.col("d") * F.col("d"))
    return e.groupBy("label").agg(F.round(F.avg(F.abs("d")), 6).alias("mae"), F.round(F.sqrt(mse), 6).alias("rmse"), F.round(10 * F.log10(1 / mse), 5).alias("psnr"))


@query("q_integer_split", "SELECT p_partkey, CAST(i AS INT) AS part, CAST(p_size // 4 + CASE WHEN i < p_size % 4 THEN 1 ELSE 0 END AS INT) AS size, format('{:+.3f}', p_retailprice - 1000) AS delta FROM part, range(4) AS t(i)")
def q_integer_split(table):
    """A whole number in four parts, the first ones larger; signed text."""
    i = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part")
    d = table("part").select("p_partkey", "p_size", "p_retailprice", i)
    size = F.floor(F.col("p_size") / 4) + (F.col("part") < F.col("p_size") % 4).cast("int")
    return d.select("p_partkey", "part", size.cast("int").alias("size"), F.format_string("%+.3f", F.col("p_retailprice") - 1000).alias("delta"))


@query("q_other_parent", f"WITH {UNIT_SQL}, s AS (SELECT label, i, avg(unit[i]) AS v FROM u, range(1, 65) AS t(i) GROUP BY label, i), d AS (SELECT a.label, b.label AS o, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM s a JOIN s b ON a.i = b.i AND a.label <> b.label GROUP BY ALL) SELECT label, arg_min(o, d) FILTER (o // 2 <> label // 2) AS rival, round((min(d) FILTER (o // 2 <> label // 2)) / (avg(d) FILTER (o // 2 = label // 2)), 6) AS ratio FROM d GROUP BY label")
def q_other_parent(table):
    """Nearest class of another parent, and its distance over that within the parent (J15). Classes are as few as labels."""
    s = unit_vectors(table).select("label", F.posexplode("unit").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    o = s.select(F.col("label").alias("o"), "i", F.col("v").alias("w"))
    d = s.join(o, "i").where("label <> o").groupBy("label", "o").agg(F.sqrt(F.sum((F.col("v") - F.col("w")) * (F.col("v") - F.col("w")))).alias("d"))
    other = F.floor(F.col("o") / 2) != F.floor(F.col("label") / 2)
    return d.groupBy("label").agg(F.min(F.when(other, F.struct("d", "o"))).alias("m"), F.avg(F.when(~other, F.col("d"))).alias("own")).select("label", F.col("m.o").alias("rival"), F.round(F.col("m.d") / F.col("own"), 6).alias("ratio"))


@query("q_anchors_and_third", f"WITH k AS ({_DRAW.format(3)}), e AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS m FROM k WHERE n > 2) SELECT label, vec_id, CAST(n - 1 AS INT) AS slot FROM k WHERE n <= 2 UNION ALL SELECT label, vec_id, 2 FROM e WHERE m = 1")
def q_anchors_and_third(table):
    """Two hash-drawn anchors stay, the third is chosen by another rule."""
    n = F.row_number().over(Window.partitionBy("label").orderBy(fn.sampling_key(F.lit(3), F.col("vec_id"))))
    k = table("embeddings").select("label", "vec_id", n.alias("n"))
    rule = F.when(F.col("n") <= 2, F.col("n")).otherwise(3)
    order = Window.partitionBy("label", "r").orderBy(F.desc("vec_id"))
    return k.withColumn("r", rule).withColumn("m", F.row_number().over(order)).where("r < 3 or m = 1").select("label", "vec_id", (F.col("r") - 1).alias("slot"))


@query("q_score_extremes", f"WITH {_LOGITS}, h AS (SELECT label, vec_id, round(-list_sum(list_transform(p, lambda v: v * ln(v))), 9) AS h FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) AS lo, row_number() OVER (PARTITION BY label ORDER BY h DESC, vec_id) AS hi FROM h) SELECT label, 'low' AS arm, vec_id FROM k WHERE lo <= 3 UNION ALL SELECT label, 'high', vec_id FROM k WHERE hi <= 3")
def q_score_extremes(table):
    """Least and most uncertain rows of each label."""
    h = soft_labels(table).select("label", "vec_id", F.round(fn.entropy(F.col("p")), 9).alias("h"))
    low = op.top_per_group(h, 3, "label", F.col("h"), F.col("vec_id")).select("label", F.lit("low").alias("arm"), "vec_id")
    return low.unionByName(op.top_per_group(h, 3, "label", F.desc("h"), F.col("vec_id")).select("label", F.lit("high").alias("arm"), "vec_id"))
