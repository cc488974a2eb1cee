"""Balanced clusters, representatives, box suppression and partners on the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import partition as part
from .registry import UNIT_SQL, query, r, unit_vectors


@query("q_balanced_clusters")
def q_balanced_clusters(table):
    """Four clusters of equal size in each label (C2); tested against all assignments of small cases."""
    return part.balanced_clusters(unit_vectors(table), 4)


@query(
    "q_representatives",
    f"""WITH {UNIT_SQL}, c AS (SELECT vec_id, label, CAST(vec_id % 3 AS INT) AS cluster, unit FROM u), s AS (SELECT label, cluster, i, sum(unit[i]) AS x FROM c, range(1, 65) AS t(i) GROUP BY ALL), n AS (SELECT label, cluster, list(x ORDER BY i) AS v FROM s GROUP BY ALL),
d AS (SELECT c.label, c.cluster, c.vec_id, round(list_dot_product(unit, v) / sqrt(list_dot_product(v, v)), 9) AS sim FROM c JOIN n ON n.label = c.label AND n.cluster = c.cluster),
k AS (SELECT *, row_number() OVER (PARTITION BY label, cluster ORDER BY sim DESC, vec_id) AS n, count(*) OVER (PARTITION BY label, cluster) AS size FROM d) SELECT label, cluster, vec_id, round(sim, 6) + 0.0 AS sim, size FROM k WHERE n = 1""",
)
def q_representatives(table):
    """The real vector nearest to each cluster's centre."""
    unit = unit_vectors(table)
    clusters = unit.select("vec_id", "label", (F.col("vec_id") % 3).cast("int").alias("cluster"))
    return part.representatives(unit, clusters).withColumn("sim", r("sim"))


@query("q_suppress_boxes")
def q_suppress_boxes(table):
    """At most three windows an order that overlap by a tenth at most."""
    q, n = F.col("l_quantity"), F.col("l_linenumber") * 3.0
    boxes = table("lineitem").select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("score"), F.array(q, n, q + 20, n + 20).alias("box"))
    return part.suppress_boxes(boxes, "l_orderkey", "score", "box", "l_linenumber", 0.1, 3)


@query("q_partners")
def q_partners(table):
    """Partners from the two classes beside the own one, within batches of twenty."""
    rows = table("embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 20).alias("batch"))
    return part.match_partners(rows, "batch", "vec_id", "label", {k: [(k + 1) % 10, (k - 1) % 10] for k in range(10)})


@query("q_guided_partners")
def q_guided_partners(table):
    """Half of each batch of twenty is led to donors of the classes beside its own, the rest keeps the pairing that was there, here the next row in
    hash order (J20, C19); tested against a plain version."""
    order = Window.partitionBy("batch").orderBy(fn.sampling_key(F.lit(29), F.col("vec_id")), "vec_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = table("embeddings").where("label is not null").select("vec_id", "label", F.floor(F.col("vec_id") / 20).alias("batch"))
    rows = rows.withColumn("partner", F.coalesce(F.lead("vec_id").over(order), F.first("vec_id").over(whole)))
    return part.guided_partners(rows, "batch", "vec_id", "label", "partner", {k: [(k + 1) % 10, (k - 1) % 10] for k in range(10)}, "pairing")
