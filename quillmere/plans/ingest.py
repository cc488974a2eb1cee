"""Logs, result records, class lists, feature and soft-label stores, written selections: the readers' parsers on the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import sources as src
from .registry import query, r


def _log_lines(table):
    """Training logs: a file for each user, one line an event, among lines that hold no metric."""
    e = table("events")
    split = F.when(F.col("event_id") % 2 == 0, "TRAIN").otherwise("TEST")
    clock = F.when(F.col("event_id") % 2 == 0, "train_time").otherwise("val_time")
    line = F.format_string(
        "%s Iter %d: lr = 0.100000, loss = %.2f, Top-1 err = %.2f, Top-5 err = %.2f, %s = %.2f",
        split, F.col("event_id") % 40, F.col("value"), F.col("value") / 8, F.col("value") / 16, clock, F.col("value") * 2,
    )
    noise = F.concat(F.lit("loading batch "), F.col("event_id").cast("string"))
    return e.select(F.col("user_id").alias("log"), F.col("event_id").alias("line"), F.explode(F.array(line, noise)).alias("value"))


@query(
    "q_log_lines",
    """
    SELECT user_id AS log, CASE WHEN event_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, CAST(event_id % 40 AS INT) AS epoch,
           count(*) AS lines, round(sum(value), 2) AS loss, round(sum(value * 2), 2) AS seconds
    FROM events GROUP BY ALL""",
)
def q_log_lines(table):
    """Typed curve rows out of log lines, other lines left out."""
    rows = _log_lines(table)
    curve = src.log_curve(rows, keep=("log",))
    g = curve.groupBy("log", "split", "epoch").agg(F.count("*").alias("lines"), F.round(F.sum("loss"), 2).alias("loss"), F.round(F.sum("seconds"), 2).alias("seconds"))
    return g.select("log", "split", "epoch", "lines", "loss", "seconds")


@query(
    "q_log_records",
    """
    WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS batch FROM events)
    SELECT user_id AS arm, batch, arg_max(event_id, event_id) AS line, arg_max(value, event_id) AS loss FROM e GROUP BY user_id, batch""",
)
def q_log_records(table):
    """JSON records with and without a prefix in a log; the last of a key counts."""
    e = table("events").withColumn("batch", F.get_json_object("props", "$.k").cast("int") % 10)
    body = F.to_json(F.struct("batch", F.col("value").alias("loss"), F.col("user_id").alias("arm"), F.col("event_id").alias("line")))
    lines = e.select(F.when(F.col("event_id") % 3 == 0, body).otherwise(F.concat(F.lit("RECOVERY_DIAG "), body)).alias("value"))
    lines = lines.unionByName(e.select(F.lit("epoch done").alias("value")))
    return src.last_records(src.prefixed_records(lines, "arm long, batch int, line long, loss double"), ["arm", "batch"])


@query("q_log_final", "SELECT user_id AS log, round(100 - arg_max(value, event_id), 2) AS accuracy FROM events WHERE event_id % 2 = 1 GROUP BY user_id")
def q_log_final(table):
    """The final metric of each log: the last line that matches."""
    found = src.last_match(_log_lines(table), r"TEST Iter .*?loss = ([0-9.]+)", "log")
    return found.select("log", F.round(100 - F.col("found"), 2).alias("accuracy"))


@query(
    "q_log_series",
    """
    WITH p AS (SELECT user_id AS log, CAST(event_id % 40 AS INT) AS epoch, arg_max(value, event_id) AS loss FROM events GROUP BY 1, 2),
    g AS (SELECT log, count(*) AS points, count(*) = 40 AS complete, max(loss) FILTER (epoch = 39) AS final, avg(loss) FILTER (epoch >= 30) AS tail FROM p GROUP BY log)
    SELECT log, points, complete, CASE WHEN complete THEN final END AS final, CASE WHEN complete THEN round(tail, 4) END AS tail_mean FROM g""",
)
def q_log_series(table):
    """Does each log hold the whole series? Its end and the mean of its tail."""
    curve = src.log_curve(_log_lines(table), keep=("log", "line"))
    points = src.last_records(curve.select("log", "epoch", "line", "loss"), ["log", "epoch"])
    return src.complete_series(points, "log", 40).withColumn("tail_mean", F.round("tail_mean", 4))


@query(
    "q_text_rows",
    """
    SELECT s_suppkey AS id, s_acctbal AS a, s_nationkey * 1.0 AS b, s_name || ' of nation' AS rest, c.s_suppkey IS NOT NULL AS known
    FROM supplier s LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) c USING (s_suppkey)""",
)
def q_text_rows(table):
    """Lines of an id, numbers and the rest of the line; is each id in the reference list?"""
    s = table("supplier")
    lines = s.select(F.concat_ws(" ", "s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double"), "s_name", F.lit("of nation")).alias("value"))
    lines = lines.unionByName(s.select(F.lit("   ").alias("value")))
    rows = src.text_rows(lines, ["id", "a", "b", "rest"], 2).withColumn("id", F.col("id").try_cast("long"))
    known = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.lit(True).alias("known"))
    return rows.join(known, "id", "left").select("id", "a", "b", "rest", F.coalesce("known", F.lit(False)).alias("known"))


@query(
    "q_class_slice",
    """
    WITH f AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS original FROM (SELECT DISTINCT n_name AS name FROM nation)),
    l AS (SELECT n_name AS name, row_number() OVER (ORDER BY sha256('5' || chr(0) || n_name), n_name) - 1 AS n FROM nation),
    m AS (SELECT n_name AS name, row_number() OVER (ORDER BY n_nationkey) - 1 AS n FROM nation)
    SELECT 'seeded' AS list, l.name, l.n - 6 AS class_id, original FROM l JOIN f USING (name) WHERE n BETWEEN 6 AND 11
    UNION ALL SELECT 'listed', m.name, m.n - 6, original FROM m JOIN f USING (name) WHERE n BETWEEN 6 AND 11""",
)
def q_class_slice(table):
    """The second six classes of a list, in its order and in a seeded one, with their places in the full list."""
    n = table("nation").select(F.col("n_name").alias("class_name"), F.col("n_nationkey").alias("place"))
    original = src.class_ids(n).withColumnRenamed("class_id", "original")
    cut = lambda seed, kind: src.class_slice(n, 6, 1, seed).join(original, "class_name").select(F.lit(kind).alias("list"), F.col("class_name").alias("name"), "class_id", "original")
    return cut(5, "seeded").unionByName(cut(0, "listed"))


@query(
    "q_first_shuffled",
    """
    SELECT label, vec_id, CAST(n - 1 AS INT) AS slot
    FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('4' || chr(0) || CAST(vec_id AS VARCHAR)), vec_id) AS n FROM embeddings)
    WHERE n <= 10""",
)
def q_first_shuffled(table):
    """The first ten of each class in hash order."""
    return src.first_shuffled(table("embeddings").select("label", "vec_id"), 10, 4, "label", "vec_id")


@query("q_mode_lookup", "SELECT l_orderkey, l_linenumber, c_mktsegment AS mode FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey")
def q_mode_lookup(table):
    """The mode of each row by its key in an index."""
    index = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_mktsegment").alias("mode"))
    return table("lineitem").select("l_orderkey", "l_linenumber").join(index, "l_orderkey")


@query(
    "q_chunk_coverage",
    """
    WITH f AS (SELECT p_size AS c, CASE WHEN p_partkey % 97 = 0 THEN 0 ELSE p_size // 10 END AS chunk FROM part),
    g AS (SELECT chunk, count(DISTINCT c) FILTER (ok) AS held, count(*) AS n, count(*) FILTER (NOT ok) AS strays
          FROM (SELECT *, chunk = c // 10 AND c BETWEEN 0 AND 49 AS ok FROM f) GROUP BY chunk)
    SELECT CAST(coalesce(k, chunk) AS INT) AS chunk, coalesce(held, 0) AS classes, coalesce(n, 0) AS rows_,
           CASE WHEN k IS NULL THEN 0 ELSE 10 END - coalesce(held, 0) AS missing, coalesce(strays, 0) AS strays
    FROM range(5) AS t(k) FULL JOIN g ON g.chunk = k""",
)
def q_chunk_coverage(table):
    """Chunks of ten classes: what each lacks, and rows that are in another chunk than their class's."""
    p = table("part")
    chunk = F.when(F.col("p_partkey") % 97 == 0, 0).otherwise(F.floor(F.col("p_size") / 10)).cast("int")
    return src.chunk_coverage(p.select(F.col("p_size").alias("class_id"), chunk.alias("chunk")), 50)


@query(
    "q_merge_shards",
    """
    WITH s AS (SELECT l_orderkey AS path, l_suppkey % 4 AS rank, l_linenumber AS place, l_partkey AS feature FROM lineitem)
    SELECT path, CAST(rank AS BIGINT) AS rank, place, feature FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank, place, feature) AS n FROM s) WHERE n = 1""",
)
def q_merge_shards(table):
    """Shards with padding merged; the first by rank and place stays."""
    s = table("lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_suppkey") % 4).cast("long").alias("rank"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("feature"))
    return src.merge_shards(s, ["path"], "rank", "place").select("path", "rank", "place", "feature")


def _store(table, epochs: int = 3, batch_size: int = 16):
    """A soft-label store: every vector once an epoch, in an order of the epoch's own, in batches."""
    e = table("embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    n = e.groupBy("epoch").agg(F.count("*").alias("n"))
    place = F.pmod(F.col("vec_id") + 7 * F.col("epoch"), F.col("n"))
    return e.join(n, "epoch").withColumn("place", place).select("epoch", F.floor(F.col("place") / batch_size).cast("int").alias("batch"), (F.col("place") % batch_size).alias("row_"), "vec_id", "label")


@query(
    "q_store_info",
    """WITH n AS (SELECT count(*) AS n FROM embeddings), c AS (SELECT e AS epoch, ((vec_id + 7 * e) % n) // 16 AS batch, count(*) AS k FROM embeddings, n, range(3) AS t(e) GROUP BY ALL)
    SELECT count(DISTINCT epoch) AS epochs, min(epoch) = 0 AND max(epoch) = count(DISTINCT epoch) - 1 AS contiguous, count(*) FILTER (epoch = 0) AS batches,
           max(k) FILTER (epoch = 0 AND batch = 0) AS batch_size, CAST(sum(k) FILTER (epoch = 0) AS BIGINT) AS images FROM c""",
)
def q_store_info(table):
    """Epochs, batches and images of a soft-label store, worked out of its records."""
    return src.store_info(_store(table))


@query(
    "q_batch_lookup",
    """
    WITH n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT e AS epoch, (vec_id + 7 * e) % n AS place, vec_id, label FROM embeddings, n, range(3) AS t(e)),
    a AS (SELECT e AS epoch, k * 48 AS start FROM range(3) AS t(e), (SELECT unnest(range((SELECT count(*) FROM embeddings) // 48 + 1)) AS k) AS u, n WHERE k * 48 < n)
    SELECT CAST(s.epoch AS INT) AS epoch, CAST(a.start AS BIGINT) AS start, CAST(place // 16 AS INT) AS batch, place % 16 AS row_, vec_id, label
    FROM s JOIN a ON a.epoch = s.epoch AND place // 16 = a.start // 16""",
)
def q_batch_lookup(table):
    """The batches that begin with the images a sampler names."""
    spark = table("nation").sparkSession
    n = table("embeddings").count()
    asked = spark.range(n // 48 + 1).select((F.col("id") * 48).alias("start"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("epoch"))
    asked = asked.unionByName(asked.withColumn("start", F.col("start") + 5))  # inside a batch: refused
    return src.batch_records(_store(table), asked, n, 16).select("epoch", "start", "batch", "row_", "vec_id", "label")


@query(
    "q_target_plan",
    """
    WITH w AS (SELECT o_orderkey % 997 AS target, min(o_custkey) AS s, count(DISTINCT o_custkey) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    h AS (SELECT c_custkey % 1200 AS target, min(c_custkey) AS s FROM customer GROUP BY 1)
    SELECT coalesce(w.target, h.target) AS target, coalesce(w.s, h.s) AS source,
           CASE WHEN w.target IS NULL THEN 'extra' WHEN n > 1 OR (h.target IS NOT NULL AND w.s IS DISTINCT FROM h.s) THEN 'collision' WHEN h.target IS NOT NULL THEN 'same' ELSE 'new' END AS state
    FROM w FULL JOIN h ON w.target = h.target""",
)
def q_target_plan(table):
    """A selection against the folder it is written to: new, same, collision, extra (K6, K7)."""
    wanted = table("orders").where("o_orderstatus = 'F'").select((F.col("o_orderkey") % 997).alias("target"), F.col("o_custkey").alias("source"))
    have = table("customer").groupBy((F.col("c_custkey") % 1200).alias("target")).agg(F.min("c_custkey").alias("source"))
    return src.target_plan(wanted, have).select("target", "source", "state")


@query(
    "q_rows_as_text",
    """
    SELECT n_nationkey, '{"k":' || n_nationkey || ',"name":"' || n_name || '","none":null}' AS json, n_nationkey || ',,' || n_name AS csv,
           '| ' || n_name || ' | ' || printf('%.2f', n_regionkey / 4.0) || ' | - |' AS report FROM nation""",
)
def q_rows_as_text(table):
    """Rows as JSON with sorted keys, as CSV and as report lines with a dash for null (K1, K2, K3, K5)."""
    n = table("nation").select("n_nationkey", F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("none"), (F.col("n_regionkey") / 4.0).alias("x"))
    keyed = lambda made, name: made.withColumnRenamed(made.columns[0], name)
    json = keyed(src.rows_as_json(n.select("name", "none", "k")), "json").withColumn("n_nationkey", F.get_json_object("json", "$.k").cast("long"))
    csv = keyed(src.rows_as_csv(n, ["k", "none", "name"]), "csv").withColumn("n_nationkey", F.split("csv", ",")[0].cast("long"))
    named = n.select(F.col("n_nationkey"), F.col("name").alias("n"))
    report = keyed(src.report_rows(n, ["name", "x", "none"], 2), "report").withColumn("n", F.split("report", r" \| ")[0].substr(3, 99)).join(named, "n").drop("n")
    return json.join(csv, "n_nationkey").join(report, "n_nationkey").select("n_nationkey", "json", "csv", "report")


@query(
    "q_labelled_matrix",
    """
    SELECT r_name, count(*) FILTER (c_mktsegment = 'FURNITURE') AS furniture, count(*) FILTER (c_mktsegment = 'BUILDING') AS building
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name""",
)
def q_labelled_matrix(table):
    """A long table as a labelled matrix, absent cells as 0 (K4, K9)."""
    c = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "right")
    long = c.groupBy("r_name", F.col("c_mktsegment").alias("segment")).agg(F.count("c_custkey").alias("n"))
    wide = src.matrix(long, "r_name", "segment", "n", ["FURNITURE", "BUILDING"])
    zero = lambda k, name: F.coalesce(F.col(k), F.lit(0)).alias(name)
    return wide.select("r_name", zero("FURNITURE", "furniture"), zero("BUILDING", "building"))


@query(
    "q_model_pool",
    """WITH e AS (SELECT event_type AS model, event_id % 5 = 0 AS held, avg(CASE WHEN value > 50 THEN 100.0 ELSE 0.0 END) AS acc, avg(value) AS loss FROM events GROUP BY ALL),
    w AS (SELECT model, max(acc) FILTER (NOT held) AS a, max(loss) FILTER (NOT held) AS b, max(acc) FILTER (held) AS c, max(loss) FILTER (held) AS d FROM e GROUP BY model)
    SELECT 0 AS line, 'Model Name,train_acc,train_loss,test_acc,test_loss' AS value
    UNION ALL SELECT CAST(row_number() OVER (ORDER BY model) AS INT), model || ',' || printf('%.4f', a) || ',' || printf('%.4f', b) || ',' || printf('%.4f', c) || ',' || printf('%.4f', d) FROM w""",
)
def q_model_pool(table):
    """One line of CSV for each model, with its accuracy and loss on both splits, below a header (K9)."""
    hit = F.avg(F.when(F.col("value") > 50, 100.0).otherwise(0.0))
    e = table("events").groupBy(F.col("event_type").alias("model"), F.when(F.col("event_id") % 5 == 0, "test").otherwise("train").alias("split")).agg(hit.alias("acc"), F.avg("value").alias("loss"))
    w = e.groupBy("model").pivot("split", ["train", "test"]).agg(F.first("acc").alias("acc"), F.first("loss").alias("loss"))
    shown = w.select("model", *(F.format_string("%.4f", c).alias(c) for c in ("train_acc", "train_loss", "test_acc", "test_loss")))
    # one row a model, so ranking them whole is small
    lines = shown.select(F.row_number().over(Window.orderBy("model")).alias("line"), F.to_csv(F.struct("model", "train_acc", "train_loss", "test_acc", "test_loss")).alias("value"))
    head = lines.sparkSession.createDataFrame([(0, "Model Name,train_acc,train_loss,test_acc,test_loss")], "line int, value string")
    return head.unionByName(lines)


@query("q_running_mean", "SELECT event_type, round(sum(value * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 5) AS mean, CAST(sum(event_id % 5 + 1) AS BIGINT) AS n FROM events GROUP BY event_type")
def q_running_mean(table):
    """Means of batches merged by how many each stands for."""
    n = F.col("event_id") % 5 + 1
    return table("events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * n) / F.sum(n), 5).alias("mean"), F.sum(n).alias("n"))


@query("q_finite_mean", "SELECT l_returnflag, count(*) FILTER (l_quantity = 7) AS masked, round(avg(l_extendedprice / l_quantity) FILTER (l_quantity <> 7), 5) AS mean FROM lineitem GROUP BY l_returnflag")
def q_finite_mean(table):
    """Values that are no finite numbers become null and do not count."""
    x = F.when(F.col("l_quantity") == 7, F.when(F.col("l_linenumber") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
    d = table("lineitem").select("l_returnflag", fn.finite(x).alias("x"))
    return d.groupBy("l_returnflag").agg(F.count_if(F.col("x").isNull()).alias("masked"), r(F.avg("x"), 5).alias("mean"))
