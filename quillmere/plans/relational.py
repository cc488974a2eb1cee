"""Joins, grids, audits, overlap, ordered series, logs and schedules on the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from .registry import query, r

#: Slices of the time axis that as-of joins sort apart: a day in microseconds.
DAY = 86_400_000_000


@query("q_first_n_per_group", "SELECT l_returnflag, l_orderkey, l_linenumber, CAST(n - 1 AS INT) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 20")
def q_first_n_per_group(table):
    """First rows of each group in key order."""
    return op.top_per_group(table("lineitem"), 20, "l_returnflag", F.col("l_orderkey"), F.col("l_linenumber")).select("l_returnflag", "l_orderkey", "l_linenumber", "slot")


@query("q_topk_per_group", "SELECT o_orderpriority, o_orderkey, CAST(n - 1 AS INT) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 10")
def q_topk_per_group(table):
    """Largest of each group, ties by key."""
    return op.top_per_group(table("orders"), 10, "o_orderpriority", F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderpriority", "o_orderkey", "slot")


@query("q_avg_tie_percentile", "SELECT doc_id, lang, round((rank() OVER (PARTITION BY lang ORDER BY n_chars) - 1 + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0) / greatest(count(*) OVER (PARTITION BY lang) - 1, 1), 6) + 0.0 AS pct FROM documents")
def q_avg_tie_percentile(table):
    """Mean rank of ties over n - 1."""
    return table("documents").select("doc_id", "lang", r(op.average_tie_percentile("n_chars", "lang")).alias("pct"))


@query("q_quintile_contrast", "WITH q AS (SELECT lang, quantile_cont(n_chars, 0.2) AS lo, quantile_cont(n_chars, 0.8) AS hi FROM documents GROUP BY lang) SELECT d.lang, round(avg(length(text)) FILTER (n_chars >= hi) - avg(length(text)) FILTER (n_chars <= lo), 4) + 0.0 AS contrast FROM documents d JOIN q ON q.lang = d.lang GROUP BY d.lang")
def q_quintile_contrast(table):
    """Mean of the top fifth less that of the bottom fifth."""
    d = table("documents")
    q = d.groupBy("lang").agg(F.percentile("n_chars", 0.2).alias("lo"), F.percentile("n_chars", 0.8).alias("hi"))
    n = F.length("text")
    return d.join(q, "lang").groupBy("lang").agg(r(F.avg(F.when(F.col("n_chars") >= F.col("hi"), n)) - F.avg(F.when(F.col("n_chars") <= F.col("lo"), n)), 4).alias("contrast"))


@query("q_median_split", "SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) <= count(*) OVER (PARTITION BY lang) // 2 THEN 'low' ELSE 'high' END AS half FROM documents")
def q_median_split(table):
    """Low and high half of each stratum."""
    w = Window.partitionBy("lang")
    n = F.row_number().over(w.orderBy("n_chars", "doc_id"))
    return table("documents").select("doc_id", "lang", F.when(n <= F.floor(F.count("*").over(w) / 2), "low").otherwise("high").alias("half"))


@query("q_missing_grid", "SELECT n_nationkey, s AS segment FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer) EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 5000")
def q_missing_grid(table):
    """Cells of the expected grid that have no run."""
    c = table("customer")
    grid = table("nation").select("n_nationkey").join(c.select(F.col("c_mktsegment").alias("segment")).distinct())
    seen = c.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"))
    return op.missing_keys(grid, seen, "n_nationkey", "segment")


@query("q_bijection", "SELECT coalesce(a.k, b.k) AS k, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM (SELECT c_custkey AS k, count(*) AS n_left FROM customer GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n_right FROM orders GROUP BY 1) b ON a.k = b.k WHERE coalesce(n_left, 0) <> 1 OR coalesce(n_right, 0) <> 1")
def q_bijection(table):
    """Keys that do not pair up one to one."""
    return op.bijection_faults(table("customer").select(F.col("c_custkey").alias("k")), table("orders").select(F.col("o_custkey").alias("k")), "k")


@query("q_contract_audit", "SELECT * FROM (SELECT 'status known' AS problem, count(*) FILTER (NOT coalesce(o_orderstatus IN ('O', 'F'), false)) AS failed, count(*) AS rows FROM orders UNION ALL SELECT 'price in range', count(*) FILTER (NOT coalesce(o_totalprice BETWEEN 1000 AND 400000, false)), count(*) FROM orders UNION ALL SELECT 'key positive', count(*) FILTER (NOT coalesce(o_orderkey >= 0, false)), count(*) FROM orders) WHERE failed > 0")
def q_contract_audit(table):
    """Failed checks, all in one pass (Q1, Q10)."""
    return op.problems(table("orders"), {"status known": F.col("o_orderstatus").isin("O", "F"), "price in range": F.col("o_totalprice").between(1000, 400000), "key positive": F.col("o_orderkey") >= 0})


@query("q_exact_dup", "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_exact_dup(table):
    """Texts that occur more than once, first one wins."""
    return table("documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("q_split_overlap", "WITH d AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT DISTINCT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) SELECT item_id, count(DISTINCT doc_id) AS docs FROM d JOIN b USING (line) WHERE length(line) >= 40 GROUP BY item_id")
def q_split_overlap(table):
    """Documents that share a whole line with a held-out item."""
    line = lambda t, k: table(t).select(k, F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 40).distinct()
    return line("documents", "doc_id").join(line("benchmark", "item_id"), "line").groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"))


@query(
    "q_near_dup_hamming",
    """
    WITH c AS (SELECT vec_id, label, CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT) + CASE WHEN embedding[64] > 0 THEN -9223372036854775808 ELSE 0 END AS code
               FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)
    SELECT a.vec_id, min(a.vec_id) OVER (PARTITION BY a.label, a.code) AS class_id,
           (SELECT count(*) FROM c b WHERE b.label = a.label AND b.vec_id <> a.vec_id AND bit_count(xor(a.code, b.code)) <= 6) AS links FROM c a""",
)
def q_near_dup_hamming(table):
    """Each vector's class of equal sign codes and how many vectors of its label are within six bits, by bands that must agree."""
    bits = [F.when(F.element_at("embedding", k + 1) > 0, F.lit(1 << k if k < 63 else -1 << 63)).otherwise(F.lit(0)).cast("long") for k in range(64)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    d = table("embeddings").where("embedding is not null and label is not null").select("vec_id", "label", code.alias("code"))
    return op.hamming_links(d, "vec_id", "label", "code", 6, 64)


@query("q_asof_events", "WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS seen FROM events WHERE event_type = 'view' GROUP BY user_id, ts) SELECT q.event_id, v.seen AS last_view FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.ts >= v.ts")
def q_asof_events(table):
    """The last view of the user at or before each purchase."""
    e = table("events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_view"))
    return op.as_of(left, right, "user_id", "ts", "last_view", width=DAY).select("event_id", "last_view")


@query("q_interval_overlap", "WITH b AS (SELECT k, k * 7.0 AS lo, k * 7.0 + 7.0 AS hi FROM range(8) AS t(k)), s AS (SELECT p_partkey, p_size - 1.0 AS lo, p_size * 1.0 AS hi, p_retailprice AS v FROM part) SELECT k, round(sum(v * (least(b.hi, s.hi) - greatest(b.lo, s.lo))) / sum(least(b.hi, s.hi) - greatest(b.lo, s.lo)), 4) AS mean FROM b JOIN s ON b.lo < s.hi AND s.lo < b.hi GROUP BY k")
def q_interval_overlap(table):
    """Bins averaged over the intervals they overlap (J25). An interval here spans at most two bins, so each is dealt to those by
    equi-join instead of a range join."""
    s = table("part").select((F.col("p_size") - 1.0).alias("lo"), (F.col("p_size") * 1.0).alias("hi"), F.col("p_retailprice").alias("v"))
    s = s.withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / 7), F.ceil(F.col("hi") / 7) - 1))).where("k between 0 and 7")
    part = F.least(F.col("k") * 7.0 + 7.0, F.col("hi")) - F.greatest(F.col("k") * 7.0, F.col("lo"))
    return s.where(part > 0).groupBy("k").agg(F.round(F.sum(F.col("v") * part) / F.sum(part), 4).alias("mean"))


@query("q_caliper_match", "WITH p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, abs(a.s_acctbal - b.s_acctbal) AS d FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey) SELECT t AS caliper, count(*) AS pairs, round(avg(d), 4) AS mean_gap FROM p, (VALUES (100), (500), (2000)) AS c(t) WHERE d <= t GROUP BY t")
def q_caliper_match(table):
    """Pairs of a stratum within several calipers (J26, J16), met in slices of the widest."""
    s = table("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    p = op.caliper_pairs(s, "s_nationkey", "s_acctbal", "s_suppkey", 2000).select(F.col("gap").alias("d"))
    t = p.select("d", F.explode(F.array(F.lit(100), F.lit(500), F.lit(2000))).alias("caliper")).where("d <= caliper")
    return t.groupBy("caliper").agg(F.count("*").alias("pairs"), F.round(F.avg("d"), 4).alias("mean_gap"))


@query("q_interleave", "SELECT doc_id, row_number() OVER (ORDER BY n, coalesce(lang, '')) AS place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)")
def q_interleave(table):
    """Round robin over strata (W20): the place of every document. A row's place follows from its own in its stratum and from the sizes of the
    strata, which are few, so no sort of all rows is needed."""
    d = table("documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return op.interleaved(d, "lang", "doc_id").select("doc_id", "place")


@query("q_cyclic_schedule", "SELECT n_nationkey, e AS epoch, CAST((n_nationkey * 7 + e) % 4 AS INT) AS source FROM nation, range(8) AS t(e)")
def q_cyclic_schedule(table):
    """Each source once in every four epochs."""
    d = table("nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("epoch"))
    return d.withColumn("source", F.pmod(F.col("n_nationkey") * 7 + F.col("epoch"), F.lit(4)))


@query("q_near_median", "WITH m AS (SELECT lang, median(n_chars) AS md FROM documents GROUP BY lang) SELECT lang, doc_id FROM (SELECT d.lang, doc_id, row_number() OVER (PARTITION BY d.lang ORDER BY abs(n_chars - md), doc_id) AS n FROM documents d JOIN m ON m.lang = d.lang) WHERE n <= 3")
def q_near_median(table):
    """The three nearest to their stratum's median."""
    d = table("documents")
    m = d.groupBy("lang").agg(F.median("n_chars").alias("md"))
    return op.top_per_group(d.join(m, "lang"), 3, "lang", F.abs(F.col("n_chars") - F.col("md")), F.col("doc_id")).select("lang", "doc_id")


@query("q_iou_boxes", "WITH b AS (SELECT p_partkey, p_size % 10 * 1.0 AS x0, p_size % 7 * 1.0 AS y0, p_size % 10 + 10.0 AS x1, p_size % 7 + 8.0 AS y1 FROM part), o AS (SELECT *, greatest(least(x1, 15) - greatest(x0, 5), 0) * greatest(least(y1, 12) - greatest(y0, 2), 0) AS i FROM b) SELECT p_partkey, round(i / ((x1 - x0) * (y1 - y0) + 100.0 - i), 6) + 0.0 AS iou FROM o")
def q_iou_boxes(table):
    """Overlap over union with a fixed box."""
    s = F.col("p_size")
    a = [s % 10 * 1.0, s % 7 * 1.0, s % 10 + 10.0, s % 7 + 8.0]
    return table("part").select("p_partkey", r(fn.box_iou(a, [F.lit(x) for x in (5.0, 2.0, 15.0, 12.0)])).alias("iou"))


@query("q_last_wins", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def q_last_wins(table):
    """Replay of a log: the last record of a key counts."""
    last = F.max(F.struct("event_id", "value"))
    return table("events").groupBy("user_id", "event_type").agg(last.alias("x")).select("user_id", "event_type", "x.event_id", "x.value")


@query("q_log_curve", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, round(avg(value), 8) + 0.0 AS mean, round(100 - avg(value), 8) AS complement FROM events GROUP BY ALL")
def q_log_curve(table):
    """Keys parsed from text, a curve of means."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table("events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), r(F.avg("value"), 8).alias("mean"), F.round(100 - F.avg("value"), 8).alias("complement"))


@query(
    "q_json_defaults",
    """SELECT event_id, coalesce(TRY_CAST(props ->> '$.k' AS INTEGER), -1) AS k, coalesce(props ->> '$.unit', 'none') AS unit, TRY_CAST(props ->> '$.at.best' AS DOUBLE) AS best,
       CASE WHEN json_exists(props, '$.k') THEN 'there' ELSE 'absent' END AS state FROM events""",
)
def q_json_defaults(table):
    """Fields of a JSON object with a default, or null, where they are absent or of another type."""
    get = lambda path: F.get_json_object("props", path)
    state = F.when(get("$.k").isNotNull(), "there").otherwise("absent")
    return table("events").select("event_id", F.coalesce(get("$.k").try_cast("int"), F.lit(-1)).alias("k"), F.coalesce(get("$.unit"), F.lit("none")).alias("unit"), get("$.at.best").try_cast("double").alias("best"), state.alias("state"))


@query("q_auc_trapezoid", "WITH s AS (SELECT user_id, epoch_us(ts) / 3.6e9 AS x, value AS y, lead(epoch_us(ts) / 3.6e9) OVER w AS x2, lead(value) OVER w AS y2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(sum((x2 - x) * (y + y2) / 2), 2) + 0.0 AS area FROM s WHERE x2 IS NOT NULL GROUP BY user_id")
def q_auc_trapezoid(table):
    """Area under each ordered series."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table("events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("x"), F.col("value").alias("y"), "ts", "event_id")
    s = s.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).where("x2 is not null")
    return s.groupBy("user_id").agg(r(F.sum((F.col("x2") - F.col("x")) * (F.col("y") + F.col("y2")) / 2), 2).alias("area"))


@query("q_slope", "SELECT event_type, round((arg_max(value, event_id) - arg_min(value, event_id)) / (max(event_id) - min(event_id)), 9) + 0.0 AS slope FROM events GROUP BY event_type")
def q_slope(table):
    """From the first to the last point."""
    a, b = F.min(F.struct("event_id", "value")), F.max(F.struct("event_id", "value"))
    s = table("events").groupBy("event_type").agg(a.alias("a"), b.alias("b"))
    return s.select("event_type", r((F.col("b.value") - F.col("a.value")) / (F.col("b.event_id") - F.col("a.event_id")), 9).alias("slope"))


@query("q_key_intersection", "SELECT o_orderpriority FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def q_key_intersection(table):
    """Keys that every arm has."""
    d = table("orders").select("o_orderpriority", "o_orderstatus").distinct()
    arms = d.agg(F.count_distinct("o_orderstatus").alias("arms"))
    return d.groupBy("o_orderpriority").agg(F.count("*").alias("n")).join(arms).where("n = arms").select("o_orderpriority")


@query(
    "q_tree_digest",
    """
    WITH p AS (SELECT lang, doc_id // 500 AS part, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS d FROM documents WHERE text IS NOT NULL GROUP BY ALL)
    SELECT lang, sha256(string_agg(d, chr(10) ORDER BY part)) AS digest FROM p GROUP BY lang""",
)
def q_tree_digest(table):
    """An ordered content digest of each stratum, over the digests of ranges of ids."""
    return op.tree_digest(table("documents"), "lang", "doc_id", "text", 500)


@query("q_hierarchy_rollup", "SELECT r_name, n_name, count(*) AS customers, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def q_hierarchy_rollup(table):
    """Fine to coarse lookup, summarised at each level."""
    c = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("q_symmetric_difference", "(SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) UNION ALL (SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))")
def q_symmetric_difference(table):
    """Keys of one side only."""
    a = table("customer").select(F.col("c_custkey").alias("k"))
    b = table("orders").select(F.col("o_custkey").alias("k")).distinct()
    return a.join(b, "k", "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, "k", "left_anti").withColumn("side", F.lit("right")))


@query("q_pair_shift", "SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS running, max(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS longest FROM conversations")
def q_pair_shift(table):
    """Neighbours, running sum and running maximum in order."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    run = w.rangeBetween(Window.unboundedPreceding, 0)
    return table("conversations").select("conv_id", "turn", F.lead("role").over(w).alias("next_role"), F.sum(n).over(run).alias("running"), F.max(n).over(run).alias("longest"))


@query("q_page_paths", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang, count(*) AS pages FROM pages GROUP BY ALL")
def q_page_paths(table):
    """Keys from paths."""
    p = table("pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("lang"))
    return p.groupBy("host", "lang").agg(F.count("*").alias("pages"))
