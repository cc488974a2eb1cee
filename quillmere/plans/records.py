"""Records built, projected and joined; schedules, plans, audits and experiment summaries that other modules do not hold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from ..functions import tails
from .inference import _t_sql
from .registry import query, r
from .relational import DAY
from .statistics import _CELL, _cells

# ---- records -------------------------------------------------------------------------------------


@query("q_wide_records", "SELECT label, vec_id, CAST(i - 1 AS INT) AS place, CAST(embedding[i] AS DOUBLE) AS x, CAST(embedding[i + 1] AS DOUBLE) AS next_x FROM embeddings, range(1, 4) AS t(i) WHERE embedding IS NOT NULL")
def q_wide_records(table):
    """One record for each place of parallel arrays."""
    e = F.col("embedding")
    rows = F.arrays_zip(F.slice(e, 1, 3).alias("x"), F.slice(e, 2, 3).alias("y"))
    d = table("embeddings").where("embedding is not null").select("label", "vec_id", F.posexplode(rows).alias("place", "p"))
    return d.select("label", "vec_id", "place", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("next_x"))


@query("q_extended_records", "SELECT p_brand, p_partkey, CAST(n - 1 AS INT) AS slot, round(p_retailprice / p_size, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice / p_size DESC, p_partkey) AS n FROM part) WHERE n <= 5")
def q_extended_records(table):
    """Records with the slot and score of their selection added."""
    scored = table("part").select("p_brand", "p_partkey", (F.col("p_retailprice") / F.col("p_size")).alias("score"))
    return op.top_per_group(scored, 5, "p_brand", F.desc("score"), F.col("p_partkey")).withColumn("score", F.round("score", 6))


@query("q_nested_paths", "SELECT user_id, max(CAST(json_extract_string(props, '$.k') AS INT)) AS k, count(*) FILTER (json_extract_string(props, '$.absent.path') IS NULL) AS absent FROM events GROUP BY user_id")
def q_nested_paths(table):
    """A path into nested records; a path that is not there is null."""
    nested = F.from_json("props", "k int, absent struct<path: string>")
    d = table("events").select("user_id", F.struct(nested.alias("run")).alias("payload"))
    return d.groupBy("user_id").agg(F.max("payload.run.k").alias("k"), F.count_if(F.col("payload.run.absent.path").isNull()).alias("absent"))


@query("q_key_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 2")
def q_key_filter(table):
    """The runs of one key (P4); the filter reaches the scan."""
    return table("lineitem").where("l_returnflag = 'A' and l_linestatus = 'F' and l_linenumber = 2").select("l_orderkey", "l_linenumber", "l_quantity")


@query("q_epoch_stride", "SELECT CAST(event_id % 100 AS INT) AS epoch, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE (event_id % 100) % 20 = 0 OR event_id % 100 = 99 GROUP BY 1")
def q_epoch_stride(table):
    """Every twentieth epoch and the last one."""
    e = table("events").select((F.col("event_id") % 100).cast("int").alias("epoch"), "value")
    return e.where((F.col("epoch") % 20 == 0) | (F.col("epoch") == 99)).groupBy("epoch").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("q_ordinal_rank", "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def q_ordinal_rank(table):
    """0-based places in order of a value (W3); ties by key, where the reference leaves them to the sort."""
    w = Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")
    return table("orders").select("o_orderpriority", "o_orderkey", (F.row_number().over(w) - 1).alias("place"))


@query("q_record_override", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'late' ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS balance, c_nationkey AS nation FROM customer")
def q_record_override(table):
    """Defaults overridden by what a second record holds."""
    base = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("balance"), F.col("c_acctbal").cast("string"))
    late = F.col("c_acctbal") < 0
    over = F.when(late, F.create_map(F.lit("segment"), F.lit("late"), F.lit("balance"), F.lit("0"))).otherwise(F.map_filter(base, lambda k, v: F.lit(False)))
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k))  # the later record wins
    d = table("customer").select("c_custkey", "c_nationkey", F.map_concat(kept, over).alias("m"))
    return d.select("c_custkey", F.col("m")["segment"].alias("segment"), F.col("m")["balance"].cast("double").alias("balance"), F.col("c_nationkey").alias("nation"))


@query("q_dimension_cap", "SELECT label, count(*) AS n, CASE WHEN count(*) < 4 THEN NULL ELSE least(50, count(*) - 2) END AS dims FROM embeddings WHERE vec_id % 37 = 0 OR label < 3 GROUP BY label")
def q_dimension_cap(table):
    """Dimensions that so few rows allow: at most n - 2 and 50, none below four rows."""
    g = table("embeddings").where("vec_id % 37 = 0 or label < 3").groupBy("label").agg(F.count("*").alias("n"))
    return g.select("label", "n", F.when(F.col("n") >= 4, F.least(F.lit(50), F.col("n") - 2)).alias("dims"))


# ---- joins ---------------------------------------------------------------------------------------


@query("q_forward_asof", "WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS seen FROM events WHERE event_type = 'view' GROUP BY user_id, ts) SELECT q.event_id, v.seen AS next_view FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.ts <= v.ts")
def q_forward_asof(table):
    """The first view of the user at or after each purchase (J23, forward)."""
    e = table("events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("next_view"))
    return op.as_of(left, right, "user_id", "ts", "next_view", forward=True, width=DAY).select("event_id", "next_view")


_DHASH_SQL = """h AS (SELECT vec_id, label, vec_id % 2 AS side,
  CAST(list_sum(list_transform(range(56), lambda i: CASE WHEN embedding[i // 7 * 8 + i % 7 + 1] < embedding[i // 7 * 8 + i % 7 + 2] THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT) AS code
  FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"""


@query(
    "q_hamming_exists",
    f"WITH {_DHASH_SQL} SELECT vec_id, side, EXISTS (SELECT 1 FROM h b WHERE b.label = h.label AND b.side <> h.side AND bit_count(xor(b.code, h.code)) <= 12) AS near FROM h",
)
def q_hamming_exists(table):
    """Has the other side a row of the same class within twelve bits of the difference hash? Both directions."""
    d = table("embeddings").where("embedding is not null and label is not null")
    d = d.select("vec_id", "label", (F.col("vec_id") % 2).alias("side"), fn.difference_hash(F.col("embedding"), 8).alias("code"))
    one, two = d.where("side = 0"), d.where("side = 1")
    return op.hamming_exists(one, two, "label", "code", 12).unionByName(op.hamming_exists(two, one, "label", "code", 12)).select("vec_id", "side", "near")


_CALIPER = """p AS (SELECT abs(a.c_acctbal - b.c_acctbal) AS d, a.c_custkey % 7 - b.c_custkey % 7 AS gain, a.c_custkey % 5 + 1 AS w
  FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey WHERE abs(a.c_acctbal - b.c_acctbal) <= 400)"""


@query(
    "q_caliper_outcomes",
    f"""
    WITH {_CALIPER} SELECT t AS caliper, count(*) AS pairs, round(avg(gain), 6) + 0.0 AS mean, round(sum(gain * w) / sum(w), 6) + 0.0 AS weighted,
    count(*) FILTER (gain > 0) AS wins, count(*) FILTER (gain = 0) AS ties, count(*) FILTER (gain < 0) AS losses FROM p, (VALUES (25), (100), (400)) AS c(t) WHERE d <= t GROUP BY t""",
)
def q_caliper_outcomes(table):
    """Pairs within calipers: plain and weighted mean gain, wins, ties, losses (J26). Pairs come from neighbouring slices of the axis."""
    c = table("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    pairs = op.caliper_pairs(c, "c_nationkey", "c_acctbal", "c_custkey", 400.0)
    gain, w = F.col("c_custkey") % 7 - F.col("other") % 7, F.col("c_custkey") % 5 + 1
    p = pairs.select("gap", gain.alias("gain"), w.alias("w"), F.explode(F.array(F.lit(25), F.lit(100), F.lit(400))).alias("caliper")).where("gap <= caliper")
    g = F.col("gain")
    return p.groupBy("caliper").agg(
        F.count("*").alias("pairs"), r(F.avg(g)).alias("mean"), r(F.sum(g * F.col("w")) / F.sum("w")).alias("weighted"),
        F.count_if(g > 0).alias("wins"), F.count_if(g == 0).alias("ties"), F.count_if(g < 0).alias("losses"),
    )


# ---- schedules and plans -------------------------------------------------------------------------


@query(
    "q_alternating_sources",
    """
    WITH h AS (SELECT c_custkey, CAST(('0x' || substring(sha256('paired' || chr(0) || '3' || chr(0) || CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 2 AS first_ FROM customer)
    SELECT c_custkey, CAST(e AS INT) AS epoch, CAST((first_ + e) % 2 AS INT) AS source FROM h, range(4) AS t(e)""",
)
def q_alternating_sources(table):
    """Two sources in turn, the first one by a hash of the parent."""
    first = F.conv(F.substring(fn.sampling_key(F.lit("paired"), F.lit(3), F.col("c_custkey")), 1, 8), 16, 10).cast("long") % 2
    d = table("customer").select("c_custkey", first.alias("first_"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("epoch"))
    return d.select("c_custkey", "epoch", ((F.col("first_") + F.col("epoch")) % 2).cast("int").alias("source"))


@query(
    "q_omit_one",
    """WITH d AS (SELECT n_nationkey, CAST(o AS INT) AS omitted, CAST(s AS INT) AS slot, CAST((o + s + 1) % 5 AS INT) AS source FROM nation, range(5) AS a(o), range(4) AS b(s))
    SELECT *, (SELECT bool_and(l = [0, 1, 2, 3]) FROM (SELECT list(slot ORDER BY slot) AS l FROM d e WHERE e.n_nationkey = d.n_nationkey GROUP BY source)) AS balanced FROM d""",
)
def q_omit_one(table):
    """Five arrangements of four slots, each without one source; every source is once in each slot, as an audit over the rows says."""
    d = table("nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("omitted"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot")).withColumn("source", (F.col("omitted") + F.col("slot") + 1) % 5)
    slots = d.groupBy("n_nationkey", "source").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    audit = slots.groupBy("n_nationkey").agg(F.every(F.col("slots") == F.array(*map(F.lit, range(4)))).alias("balanced"))
    return d.join(audit, "n_nationkey")


@query("q_repeated_epochs", "SELECT p_partkey, CAST(e AS INT) AS epoch, count(*) OVER (PARTITION BY e) AS rows_ FROM part, range(3) AS t(e)")
def q_repeated_epochs(table):
    """A table read for three epochs, all rows in each."""
    d = table("part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("epoch"))
    return d.join(d.groupBy("epoch").agg(F.count("*").alias("rows_")), "epoch").select("p_partkey", "epoch", "rows_")


@query(
    "q_equal_budget",
    """
    WITH k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('29' || chr(0) || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS n FROM embeddings),
    t AS (SELECT label, vec_id, CAST(n // 5 AS INT) AS batch, CAST(n % 5 AS INT) AS place FROM k WHERE n < 25)
    SELECT label, batch, place, vec_id, count(*) OVER (PARTITION BY label) = 25 AS exact FROM t""",
)
def q_equal_budget(table):
    """Rows of each class dealt to five batches of five, and whether the class has its whole budget."""
    e = table("embeddings").select("label", "vec_id")
    picked = op.top_per_group(e, 25, "label", fn.sampling_key(F.lit(29), F.col("vec_id")), F.col("vec_id"), slot="n")
    whole = picked.groupBy("label").agg((F.count("*") == 25).alias("exact"))
    return picked.join(whole, "label").select("label", F.floor(F.col("n") / 5).cast("int").alias("batch"), (F.col("n") % 5).alias("place"), "vec_id", "exact")


# ---- audits --------------------------------------------------------------------------------------


@query(
    "q_rebuilt_totals",
    """
    WITH g AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_returnflag <> 'R') AS correct, round(100.0 * count(*) FILTER (l_returnflag <> 'R') / count(*), 8) AS accuracy FROM lineitem GROUP BY 1),
    p AS (SELECT *, CASE WHEN l_orderkey % 50 = 0 THEN accuracy + 1 ELSE accuracy END AS said, CASE WHEN l_orderkey % 70 = 0 THEN total + 1 ELSE total END AS said_total FROM g)
    SELECT problem, n FROM (SELECT 'accuracy' AS problem, count(*) FILTER (abs(said - accuracy) > 1e-8) AS n FROM p
    UNION ALL SELECT 'totals', count(*) FILTER (said_total <> total) FROM p UNION ALL SELECT 'whole', (sum(said_total) <> sum(total))::BIGINT FROM p) WHERE n > 0""",
)
def q_rebuilt_totals(table):
    """Reported totals and accuracies against those rebuilt from the rows; all mismatches are listed (Q2)."""
    right = F.col("l_returnflag") != "R"
    g = table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(right).alias("correct"))
    g = g.withColumn("accuracy", F.round(100.0 * F.col("correct") / F.col("total"), 8))
    said = F.col("accuracy") + (F.col("l_orderkey") % 50 == 0).cast("int")
    reported = g.select("l_orderkey", said.alias("accuracy"), (F.col("total") + (F.col("l_orderkey") % 70 == 0).cast("int")).alias("total"))
    return op.rebuilt(reported, table("lineitem").select("l_orderkey", right.alias("correct")), "l_orderkey", "correct")


@query(
    "q_same_provenance",
    """
    WITH m AS (SELECT o_orderpriority AS arm, o_custkey % 20 AS run, sha256(CAST(o_custkey % 20 AS VARCHAR) || CASE WHEN o_custkey % 20 = 3 AND o_orderpriority = '5-LOW' THEN 'other' ELSE '' END) AS digest FROM orders)
    SELECT run, count(DISTINCT arm) AS arms, count(DISTINCT digest) = 1 AS same, count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM m) AS whole FROM m GROUP BY run""",
)
def q_same_provenance(table):
    """Do all arms of a run carry the same manifest digest, and are all there? (Q5)"""
    run = F.col("o_custkey") % 20
    odd = (run == 3) & (F.col("o_orderpriority") == "5-LOW")
    m = table("orders").select(F.col("o_orderpriority").alias("arm"), run.alias("run"), F.sha2(F.concat(run.cast("string"), F.when(odd, "other").otherwise("")), 256).alias("digest"))
    arms = m.agg(F.count_distinct("arm").alias("all_arms"))
    g = m.groupBy("run").agg(F.count_distinct("arm").alias("arms"), (F.count_distinct("digest") == 1).alias("same"))
    return g.join(arms).select("run", "arms", "same", (F.col("arms") == F.col("all_arms")).alias("whole"))


@query(
    "q_cluster_provenance",
    """
    WITH s AS (SELECT p_partkey, p_size % 10 AS class_id FROM part),
    p AS (SELECT CASE WHEN p_partkey % 50 = 7 THEN p_partkey + 1 ELSE p_partkey END AS path, CASE WHEN p_partkey % 40 = 1 THEN 99 ELSE p_size % 10 END AS class_id,
                 CASE WHEN p_partkey % 30 = 2 THEN 1.5 WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size / 60.0 END AS prob FROM part),
    d AS (SELECT path, count(*) AS n FROM p GROUP BY path)
    SELECT problem, n FROM (SELECT 'repeated' AS problem, count(*) AS n FROM d WHERE n > 1
    UNION ALL SELECT 'not covered', count(*) FROM s WHERE p_partkey NOT IN (SELECT path FROM p)
    UNION ALL SELECT 'unknown', count(*) FROM d WHERE path NOT IN (SELECT p_partkey FROM s)
    UNION ALL SELECT 'class', count(*) FROM p JOIN s ON p.path = s.p_partkey WHERE p.class_id <> s.class_id
    UNION ALL SELECT 'membership', count(*) FROM p WHERE prob NOT BETWEEN 0 AND 1) WHERE n > 0""",
)
def q_cluster_provenance(table):
    """Provenance rows against their sources: repeats, coverage, classes, membership probabilities (Q8)."""
    p, k = table("part"), F.col("p_partkey")
    source = p.select(k.alias("path"), (F.col("p_size") % 10).alias("class_id"))
    prob = F.when(k % 30 == 2, 1.5).when(k % 3 != 0, F.col("p_size") / 60.0)
    rows = p.select(F.when(k % 50 == 7, k + 1).otherwise(k).alias("path"), F.when(k % 40 == 1, 99).otherwise(F.col("p_size") % 10).alias("class_id"), prob.alias("membership"))
    return op.provenance_faults(rows, source, "path", "class_id", "membership")


# ---- experiments ---------------------------------------------------------------------------------

_SQUARES = f"""c AS (SELECT arm, seed, avg(v) AS x FROM ({_CELL}) GROUP BY 1, 2),
m AS (SELECT *, avg(x) OVER (PARTITION BY arm) AS ra, avg(x) OVER (PARTITION BY seed) AS cs, avg(x) OVER () AS g FROM c),
k AS (SELECT count(DISTINCT arm) AS a, count(DISTINCT seed) AS b FROM c),
q AS (SELECT a, b, any_value(g) AS mean, sum((ra - g) * (ra - g)) / (a - 1) AS m1, sum((cs - g) * (cs - g)) / (b - 1) AS m2, sum((x - ra - cs + g) * (x - ra - cs + g)) / ((a - 1) * (b - 1)) AS me,
  sum((x - ra) * (x - ra)) / (a * (b - 1)) AS mw FROM m, k GROUP BY a, b),
v AS (SELECT *, greatest((m1 - me) / b, 0) AS v1, greatest((m2 - me) / a, 0) AS v2, greatest((m1 - mw) / b, 0) AS w1 FROM q)"""


@query(
    "q_variance_components",
    f"WITH {_SQUARES} SELECT round(v1, 2) AS var_arm, round(v2, 2) AS var_seed, round(me, 2) AS var_rest, round(v1 / (v1 + v2 + me), 6) AS share_arm, round(v2 / (v1 + v2 + me), 6) AS share_seed, round(me / (v1 + v2 + me), 6) AS share_rest, round(w1 / (w1 + mw), 6) AS icc FROM v",
)
def q_variance_components(table):
    """Two-way random components, their shares, and the one-way intraclass correlation (M8)."""
    c = _cells(table).groupBy("arm", "seed").agg(F.avg("v").alias("x"))
    v = op.two_way_components(c, "arm", "seed", "x")
    total = F.col("var_a") + F.col("var_b") + F.col("var_rest")
    share = lambda k: F.round(F.col(k) / total, 6)
    return v.select(
        F.round("var_a", 2).alias("var_arm"), F.round("var_b", 2).alias("var_seed"), F.round("var_rest", 2).alias("var_rest"),
        share("var_a").alias("share_arm"), share("var_b").alias("share_seed"), share("var_rest").alias("share_rest"), F.round("icc", 6).alias("icc"),
    )


@query(
    "q_crossed_interval",
    f"WITH {_SQUARES}, s AS (SELECT mean, sqrt(me / (a * b)) AS se, (a - 1) * (b - 1) AS df FROM v) SELECT round(mean - 149000, 3) + 0.0 AS mean, round(se, 4) AS se, CAST(df AS BIGINT) AS df, round({_t_sql('(mean - 149000) / se', 'df')}, 5) + 0.0 AS p FROM s",
)
def q_crossed_interval(table):
    """The mean of a crossed design with the deviation that both blocks leave, and its two-sided p."""
    c = _cells(table).groupBy("arm", "seed").agg((F.avg("v") - 149000).alias("x"))
    v = op.two_way_components(c, "arm", "seed", "x").select("mean", F.sqrt(F.col("var_rest") / (F.col("a") * F.col("b"))).alias("se"), ((F.col("a") - 1) * (F.col("b") - 1)).alias("df"))
    p = tails.t_p(F.col("mean") / F.col("se"), F.col("df").cast("double"))
    return v.select(r("mean", 3).alias("mean"), F.round("se", 4).alias("se"), "df", r(p, 5).alias("p"))


_BLOCKS = f"""g AS (SELECT seed, stat, avg(v) FILTER (arm = 'A') - avg(v) FILTER (arm = 'R') AS g1, avg(v) FILTER (arm = 'N') - avg(v) FILTER (arm = 'R') AS g2 FROM ({_CELL}) GROUP BY ALL),
l AS (SELECT 'A' AS arm, seed, g1 AS g FROM g WHERE g1 IS NOT NULL UNION ALL SELECT 'N', seed, g2 FROM g WHERE g2 IS NOT NULL),
e AS (SELECT *, g - avg(g) OVER (PARTITION BY arm, seed) AS e FROM l),
s AS (SELECT arm, avg(g) AS mean, count(*) - count(DISTINCT seed) AS df, sqrt(sum(e * e) / (count(*) - count(DISTINCT seed)) / count(*)) AS se FROM e GROUP BY arm HAVING count(*) > count(DISTINCT seed))"""


@query(
    "q_block_adjusted",
    f"""
    WITH {_BLOCKS}, p AS (SELECT *, {_t_sql('mean / se', 'df')} AS p FROM s),
    k AS (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, arm) + 1)) AS step FROM p)
    SELECT arm, round(mean, 3) + 0.0 AS mean, round(se, 3) AS se, df, round(p, 5) AS p, round(max(step) OVER (ORDER BY p, arm ROWS UNBOUNDED PRECEDING), 5) AS adjusted FROM k""",
)
def q_block_adjusted(table):
    """Mean contrasts with the deviation within blocks of seeds, and the step-down adjustment over the family."""
    from ..operators import inference as inf

    g = _cells(table).groupBy("seed", "stat").pivot("arm", ["A", "N", "R"]).agg(F.avg("v"))
    pairs = F.array(*(F.struct(F.lit(a).alias("arm"), (F.col(a) - F.col("R")).alias("g")) for a in ("A", "N")))
    long = g.select("seed", F.explode(pairs).alias("p")).select("p.arm", "seed", "p.g").where("g is not null")
    s = op.block_adjusted(long, "arm", "seed", "g").where("df > 0")
    s = s.withColumn("p", tails.t_p(F.col("mean") / F.col("se"), F.col("df").cast("double")))
    return inf.holm(s, "p", "arm").select("arm", r("mean", 3).alias("mean"), F.round("se", 3).alias("se"), "df", F.round("p", 5).alias("p"), F.round("adjusted", 5).alias("adjusted"))


@query(
    "q_best_level_pairs",
    f"""
    WITH c AS (SELECT arm, stat AS level, seed, avg(v) AS x FROM ({_CELL}) GROUP BY ALL), m AS (SELECT arm, level, avg(x) AS x FROM c GROUP BY ALL),
    b AS (SELECT arm, arg_max(level, x) AS best FROM m GROUP BY arm), k AS (SELECT c.arm, best, seed, x FROM c JOIN b ON b.arm = c.arm AND b.best = c.level),
    d AS (SELECT a.arm, o.arm AS other, a.best, o.best AS other_best, a.x - o.x AS g FROM k a JOIN k o ON a.seed = o.seed AND a.arm < o.arm)
    SELECT arm, other, best, other_best, count(*) AS seeds, round(avg(g), 3) + 0.0 AS gain, round(stddev_samp(g), 3) AS sd FROM d GROUP BY ALL""",
)
def q_best_level_pairs(table):
    """Arms compared seed by seed, each at its own best level."""
    c = _cells(table).groupBy("arm", F.col("stat").alias("level"), "seed").agg(F.avg("v").alias("x"))
    means = c.groupBy("arm", "level").agg(F.avg("x").alias("m"))
    best = means.groupBy("arm").agg(F.max(F.struct("m", "level")).alias("b")).select("arm", F.col("b.level").alias("level"))
    k = c.join(best, ["arm", "level"]).withColumnRenamed("level", "best")
    o = k.select(F.col("arm").alias("other"), F.col("best").alias("other_best"), "seed", F.col("x").alias("y"))
    d = k.join(o, "seed").where("arm < other").groupBy("arm", "other", "best", "other_best")
    g = F.col("x") - F.col("y")
    return d.agg(F.count("*").alias("seeds"), r(F.avg(g), 3).alias("gain"), F.round(F.stddev_samp(g), 3).alias("sd"))


@query("q_zero_sd", "SELECT l_orderkey, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 4) AS sd FROM lineitem GROUP BY l_orderkey")
def q_zero_sd(table):
    """Groups of one row have deviation 0 instead of none (A2)."""
    g = table("lineitem").groupBy("l_orderkey").agg(*op.sample_stats("l_quantity", zero_sd=True))
    return g.select("l_orderkey", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query(
    "q_two_level_tables",
    f"""
    WITH c AS (SELECT arm, seed, avg(v) AS x FROM ({_CELL}) GROUP BY 1, 2)
    SELECT 'arm' AS by_, arm AS level, count(*) AS n, round(avg(x), 3) AS mean, round(stddev_samp(x), 3) AS sd FROM c GROUP BY arm
    UNION ALL SELECT 'seed', CAST(seed AS VARCHAR), count(*), round(avg(x), 3), round(stddev_samp(x), 3) FROM c GROUP BY seed""",
)
def q_two_level_tables(table):
    """The same cells summarised by either factor."""
    c = _cells(table).groupBy("arm", "seed").agg(F.avg("v").alias("x"))
    by = lambda k: c.groupBy(F.lit(k).alias("by_"), F.col(k).cast("string").alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 3).alias("mean"), F.round(F.stddev_samp("x"), 3).alias("sd"))
    return by("arm").unionByName(by("seed"))


@query(
    "q_moving_centre_last",
    """
    WITH RECURSIVE d AS (SELECT event_type, CAST(hour(ts) AS INT) AS step, arg_max(value, event_id) AS v, count(*) AS n FROM events GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY step) AS k FROM d),
    c AS (SELECT event_type, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS centre FROM (SELECT DISTINCT event_type FROM o) UNION ALL SELECT o.event_type, o.k, c.centre + 0.5 * (o.v - c.centre) / o.n FROM c JOIN o ON o.event_type = c.event_type AND o.k = c.k + 1)
    SELECT event_type, max(k) AS steps, round(max_by(centre, k), 6) + 0.0 AS centre FROM c GROUP BY event_type""",
)
def q_moving_centre_last(table):
    """The moving centre where the last row of a batch is what counts, divided by the batch's rows (A47, the other reading)."""
    d = table("events").groupBy("event_type", F.hour("ts").alias("step")).agg(F.max_by("value", "event_id").alias("v"), F.count("*").alias("n"))
    s = d.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("step", "v", "n"))).alias("s"))
    centre = F.aggregate("s", F.lit(0.0), lambda a, x: a + 0.5 * (x["v"] - a) / x["n"])
    return s.select("event_type", F.size("s").cast("long").alias("steps"), r(centre).alias("centre"))


@query(
    "q_pass_gate",
    f"""
    WITH c AS (SELECT stat AS setting, seed AS arm, avg(v) AS score, sum(v) / count(*) + seed AS loss FROM ({_CELL}) GROUP BY stat, seed),
    k AS (SELECT *, rank() OVER (PARTITION BY setting ORDER BY score) + (count(*) OVER (PARTITION BY setting, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY setting ORDER BY loss) + (count(*) OVER (PARTITION BY setting, loss) - 1) / 2.0 AS b FROM c)
    SELECT setting, round(corr(a, b), 6) AS rho, corr(a, b) >= 0.9 AS strong, max(score) FILTER (arm = 1996) < max(score) FILTER (arm = 1997) AS ordered,
           abs(max(a) FILTER (arm = 1996) - max(a) FILTER (arm = 1997)) <= 1 AS adjacent,
           abs(max(score) FILTER (arm = 1996) - max(score) FILTER (arm = 1997)) <= 0.25 * (max(score) - min(score)) AS close FROM k GROUP BY setting""",
)
def q_pass_gate(table):
    """A gate of each setting: rank correlation, the order of a pair, their ranks beside each other, their closeness."""
    c = _cells(table).groupBy(F.col("stat").alias("setting"), F.col("seed").alias("arm")).agg(F.avg("v").alias("score"), (F.sum("v") / F.count("*") + F.col("seed")).alias("loss"))
    k = c.withColumns({"a": op.average_rank("score", "setting"), "b": op.average_rank("loss", "setting")})
    of = lambda x, arm: F.max(F.when(F.col("arm") == arm, F.col(x)))
    rho = fn.correlation(F.col("a"), F.col("b"))
    return k.groupBy("setting").agg(
        F.round(rho, 6).alias("rho"), (rho >= 0.9 - 1e-12).alias("strong"), (of("score", 1996) < of("score", 1997)).alias("ordered"),
        (F.abs(of("a", 1996) - of("a", 1997)) <= 1).alias("adjacent"),
        (F.abs(of("score", 1996) - of("score", 1997)) <= 0.25 * (F.max("score") - F.min("score"))).alias("close"),
    )


# ---- permutations --------------------------------------------------------------------------------


@query("q_most_disorder")
def q_most_disorder(table):
    """For each part's permutation of seven places the one with the same pairs of neighbours that is farthest from the identity (L13); tested
    against all permutations."""
    places = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.struct(F.sha2(F.concat_ws("-", F.col("p_partkey"), k.cast("string")), 256).alias("h"), k.alias("k"))))
    d = table("part").select("p_partkey", F.transform(places, lambda s: s["k"]).alias("sigma"))
    return op.most_disorder(d, "p_partkey", "sigma")
