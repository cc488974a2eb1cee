"""Plans of batches and orders, densities along an axis, reference rows, seeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from ..functions import softlabels as sl
from .geometry import _LOGITS, soft_labels
from .registry import query, r


@query("q_pseudo_classes", "SELECT vec_id, label, CAST(ntile(3) OVER (PARTITION BY label ORDER BY sha256('19' || chr(0) || CAST(vec_id AS VARCHAR))) - 1 AS INT) AS pseudo FROM embeddings")
def q_pseudo_classes(table):
    """Random parts of each label, of near-equal size."""
    order = Window.partitionBy("label").orderBy(fn.sampling_key(F.lit(19), F.col("vec_id")))
    return table("embeddings").select("vec_id", "label", (F.ntile(3).over(order) - 1).alias("pseudo"))


@query("q_batch_plan", "WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, CAST(b AS INT) AS batch, CAST(30 // 4 + CASE WHEN b < 30 % 4 THEN 1 ELSE 0 END AS INT) AS rows_, n FROM g, range(4) AS t(b)")
def q_batch_plan(table):
    """The same budget of thirty rows for each label, over four batches: how many rows each gets."""
    g = table("embeddings").groupBy("label").agg(F.count("*").alias("n"))
    b = g.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return b.select("label", "batch", (F.lit(7) + (F.col("batch") < 2).cast("int")).alias("rows_"), "n")


@query("q_sampler_replay", "SELECT label, epoch, vec_id, CAST((n - 1) // 16 AS INT) AS batch, CAST((n - 1) % 16 AS INT) AS offset_ FROM (SELECT label, CAST(epoch AS INT) AS epoch, vec_id, row_number() OVER (PARTITION BY label, epoch ORDER BY sha256('23' || chr(0) || CAST(epoch AS VARCHAR) || chr(0) || CAST(vec_id AS VARCHAR))) AS n FROM embeddings, range(3) AS t(epoch))")
def q_sampler_replay(table):
    """Each epoch's own hash order, cut into batches."""
    d = table("embeddings").select("label", "vec_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("epoch"))
    n = F.row_number().over(Window.partitionBy("label", "epoch").orderBy(fn.sampling_key(F.lit(23), F.col("epoch"), F.col("vec_id")))) - 1
    return d.withColumn("n", n).select("label", "epoch", "vec_id", F.floor(F.col("n") / 16).cast("int").alias("batch"), (F.col("n") % 16).alias("offset_"))


@query("q_sibling_reference", "WITH m AS (SELECT o_orderpriority AS arm, CAST(year(o_orderdate) AS INT) AS seed, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2) SELECT a.arm, a.seed, round(a.x - b.x, 4) + 0.0 AS over_reference FROM m a JOIN m b ON a.seed = b.seed AND b.arm = CASE WHEN a.arm <= '3' THEN '1-URGENT' ELSE '5-LOW' END")
def q_sibling_reference(table):
    """The reference run depends on the arm."""
    m = table("orders").groupBy(F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("seed")).agg(F.avg("o_totalprice").alias("x"))
    base = m.select(F.col("arm").alias("reference"), "seed", F.col("x").alias("y"))
    named = m.withColumn("reference", F.when(F.col("arm") <= "3", "1-URGENT").otherwise("5-LOW"))
    return named.join(base, ["reference", "seed"]).select("arm", "seed", r(F.col("x") - F.col("y"), 4).alias("over_reference"))


@query("q_shard_union", "WITH u AS (SELECT vec_id, 0 AS shard FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, 1 FROM embeddings WHERE vec_id % 3 = 0) SELECT count(*) AS rows_, count(DISTINCT vec_id) AS keys, count(*) - count(DISTINCT vec_id) AS overlap FROM u")
def q_shard_union(table):
    """Shards put together, with what they share."""
    e = table("embeddings").select("vec_id")
    u = e.where("vec_id % 2 = 0").unionByName(e.where("vec_id % 3 = 0"))
    return u.agg(F.count("*").alias("rows_"), F.count_distinct("vec_id").alias("keys"), (F.count("*") - F.count_distinct("vec_id")).alias("overlap"))


@query("q_nested_ranks", "WITH k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(embedding[1], 6) DESC, vec_id) AS n FROM embeddings) SELECT label, min(vec_id) FILTER (n = 1) AS first_, count(*) FILTER (n <= 3) AS three, count(*) FILTER (n <= 10) AS ten FROM k GROUP BY label")
def q_nested_ranks(table):
    """Nested selections from one ranked list share their first row."""
    order = (F.desc(F.round(F.col("embedding")[0], 6)), F.col("vec_id"))
    k = op.top_per_group(table("embeddings"), 10, "label", *order)
    return k.groupBy("label").agg(F.min(F.when(F.col("slot") == 0, F.col("vec_id"))).alias("first_"), F.count_if(F.col("slot") < 3).alias("three"), F.count("*").alias("ten"))


@query("q_class_accuracy", f"WITH {_LOGITS}, c AS (SELECT label, count(*) AS n, sum((list_position(p, list_max(p)) - 1 = label)::INT) AS ok FROM f GROUP BY label) SELECT label, CAST(ok AS BIGINT) AS correct, n AS total, round(ok / n * 100, 4) AS accuracy, round(sum(ok) OVER () / sum(n) OVER () * 100, 4) AS micro FROM c")
def q_class_accuracy(table):
    """Accuracy by class and the whole rebuilt from the classes."""
    c = soft_labels(table).groupBy("label").agg(F.count_if(fn.first_arg_max(F.col("p")) == F.col("label")).alias("correct"), F.count("*").alias("total"))
    whole = c.agg((F.sum("correct") / F.sum("total") * 100).alias("m"))
    return c.join(whole).select("label", "correct", "total", F.round(F.col("correct") / F.col("total") * 100, 4).alias("accuracy"), F.round("m", 4).alias("micro"))


@query("q_source_profile", f"WITH {_LOGITS}, h AS (SELECT label, -ln(p[label + 1]) AS ce, list_position(p, list_max(p)) - 1 IN (label, (label + 1) % 10) AS valid FROM f) SELECT label, round(avg(ce), 6) AS ce, round(avg(valid::INT), 6) AS valid, round(quantile_cont(ce, 0.1), 6) + 0.0 AS p10, round(median(ce), 6) + 0.0 AS p50, round(quantile_cont(ce, 0.9), 6) AS p90 FROM h GROUP BY label")
def q_source_profile(table):
    """Cross-entropy and whether one of two sources is the first choice."""
    d = soft_labels(table).select("label", fn.negative_log(F.element_at("p", F.col("label") + 1)).alias("ce"), fn.first_arg_max(F.col("p")).alias("best"))
    valid = (F.col("best") == F.col("label")) | (F.col("best") == (F.col("label") + 1) % 10)
    return d.groupBy("label").agg(F.round(F.avg("ce"), 6).alias("ce"), F.round(F.avg(valid.cast("int")), 6).alias("valid"), *(r(F.percentile("ce", q)).alias(f"p{round(q * 100)}") for q in (0.1, 0.5, 0.9)))


@query("q_namespace_seed", "SELECT doc_id, CAST(CAST('0x' || substring(sha256('ns' || chr(0) || '7' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 16) AS UBIGINT) % CAST(9223372036854775807 AS UBIGINT) AS BIGINT) AS seed FROM documents")
def q_namespace_seed(table):
    """Big-endian seeds below 2^63 - 1."""
    head = F.conv(F.substring(fn.sampling_key(F.lit("ns"), F.lit(7), F.col("doc_id")), 1, 16), 16, 10).cast("decimal(20,0)")
    return table("documents").select("doc_id", (head % F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long").alias("seed"))


@query("q_interpolate", "WITH k AS (SELECT p_partkey, p_size * 1.0 AS x FROM part) SELECT p_partkey, round(CASE WHEN x < 10 THEN x / 10 * 5 WHEN x < 30 THEN 5 + (x - 10) / 20 * 2 ELSE least(7 + (x - 30) / 15 * 9, 16) END, 6) AS y FROM k")
def q_interpolate(table):
    """A piecewise-linear curve through four knots."""
    xs, ys = F.lit([0.0, 10.0, 30.0, 45.0]), F.lit([0.0, 5.0, 7.0, 16.0])
    return table("part").select("p_partkey", F.round(sl.interpolate(xs, ys, F.col("p_size").cast("double")), 6).alias("y"))


@query("q_interval_density", "WITH d AS (SELECT p_partkey, p_size % 8 AS a, i, CASE WHEN i >= p_size % 8 AND i < p_size % 8 + 6 THEN 1.0 ELSE 0.25 END AS v FROM part, range(16) AS t(i)), m AS (SELECT p_partkey, avg(v) AS m FROM d GROUP BY 1) SELECT p_partkey, round(max(v / m), 6) AS inside, round(min(v / m), 6) AS outside, round(sum(v / m), 6) AS mass FROM d JOIN m USING (p_partkey) GROUP BY p_partkey")
def q_interval_density(table):
    """Two levels along an axis."""
    a = F.col("p_size") % 8
    d = table("part").select("p_partkey", sl.interval_density(16, a, a + 6, 0.25).alias("d"))
    return d.select("p_partkey", F.round(F.array_max("d"), 6).alias("inside"), F.round(F.array_min("d"), 6).alias("outside"), F.round(fn.total(F.col("d")), 6).alias("mass"))


@query(
    "q_allocate",
    """
    WITH RECURSIVE w AS (SELECT vec_id, list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)) + 0.01) AS w FROM embeddings WHERE embedding IS NOT NULL),
    s AS (SELECT vec_id, w, CAST(0 AS DOUBLE) AS lo, 3.0 / list_min(w) AS hi, 0 AS k FROM w
          UNION ALL SELECT vec_id, w, CASE WHEN list_sum(list_transform(w, lambda v: greatest(0.5, least(3.0, v * (lo + hi) / 2)))) < 64 THEN (lo + hi) / 2 ELSE lo END,
                           CASE WHEN list_sum(list_transform(w, lambda v: greatest(0.5, least(3.0, v * (lo + hi) / 2)))) < 64 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM s WHERE k < 60),
    a AS (SELECT vec_id, list_transform(w, lambda v: greatest(0.5, least(3.0, v * hi))) AS a FROM s WHERE k = 60)
    SELECT vec_id, round(list_sum(a), 6) AS mass, round(a[1], 5) AS first_, round(list_max(a), 5) AS largest, len(list_filter(a, lambda v: v <= 0.5)) AS at_least,
           len(list_filter(a, lambda v: v >= 3.0)) AS at_most FROM a""",
)
def q_allocate(table):
    """Allocations clamped to [0.5, 3] that add up to 64 (F20): their sum, the first and largest share, and how many are at either bound."""
    w = F.transform(fn.doubles(F.col("embedding")), lambda v: F.abs(v) + 0.01)
    d = table("embeddings").where("embedding is not null").select("vec_id", sl.allocate(w, F.lit(64.0), 0.5, 3.0).alias("a"))
    n = lambda keep: F.size(F.filter("a", keep)).cast("long")
    return d.select(
        "vec_id", F.round(fn.total(F.col("a")), 6).alias("mass"), F.round(F.col("a")[0], 5).alias("first_"), F.round(F.array_max("a"), 5).alias("largest"),
        n(lambda v: v <= 0.5).alias("at_least"), n(lambda v: v >= 3.0).alias("at_most"),
    )


@query("q_best_window", "WITH w AS (SELECT vec_id, y, x, round(list_sum(list_transform(range(9), lambda i: CAST(embedding[(y + i // 3) * 8 + x + i % 3 + 1] AS DOUBLE))) / 9, 9) AS m FROM embeddings, range(6) AS a(y), range(6) AS b(x)), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY m DESC, y, x) AS n FROM w) SELECT vec_id, round(m, 6) + 0.0 AS mean, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM k WHERE n = 1")
def q_best_window(table):
    """The best three by three window of an 8 by 8 map."""
    d = table("embeddings").select("vec_id", sl.best_window(fn.doubles(F.col("embedding")), 8, 3).alias("b"))
    return d.select("vec_id", r("b.mean").alias("mean"), "b.y", "b.x")


@query("q_matched_contrast", "SELECT l_returnflag, round(avg(x) FILTER (a = b) - avg(x) FILTER (a <> b), 4) + 0.0 AS contrast FROM (SELECT l_returnflag, l_linenumber % 3 AS a, l_orderkey % 3 AS b, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1")
def q_matched_contrast(table):
    """Mean of the matched cells less that of the others, by key."""
    cells = table("lineitem").groupBy("l_returnflag", (F.col("l_linenumber") % 3).alias("a"), (F.col("l_orderkey") % 3).alias("b")).agg(F.avg("l_extendedprice").alias("x"))
    matched = F.col("a") == F.col("b")
    return cells.groupBy("l_returnflag").agg(r(F.avg(F.when(matched, F.col("x"))) - F.avg(F.when(~matched, F.col("x"))), 4).alias("contrast"))


@query("q_top_stratum_halves", "WITH k AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n, count(*) OVER (PARTITION BY lang) AS size FROM documents), t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS m, count(*) OVER (PARTITION BY lang) AS taken FROM k WHERE n <= ceil(0.2 * size)) SELECT lang, doc_id, CASE WHEN m <= taken // 2 THEN 'low' ELSE 'high' END AS half FROM t")
def q_top_stratum_halves(table):
    """The top fifth of each group by one measure, halved by another."""
    by = Window.partitionBy("lang")
    n = F.row_number().over(by.orderBy(F.desc("n_chars"), "doc_id"))
    top = table("documents").select("doc_id", "lang", "source", "n_chars").withColumns({"n": n, "size": F.count("*").over(by)}).where(F.col("n") <= F.ceil(0.2 * F.col("size")))
    m = F.row_number().over(by.orderBy("source", "doc_id"))
    return top.withColumns({"m": m, "taken": F.count("*").over(by)}).select("lang", "doc_id", F.when(F.col("m") <= F.floor(F.col("taken") / 2), "low").otherwise("high").alias("half"))
