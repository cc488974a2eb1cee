"""Reading class folders, result files and logs; writing results. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import functions as fn

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")


def class_folders(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """``path, class_name, class_id, size_bytes`` of the files in class folders; ids follow the sorted folder names. File contents
    are not read: only path and length are selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select("path", F.element_at(F.split("path", "/"), -2).alias("class_name"), F.col("length").alias("size_bytes"))
    rows = rows.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*suffixes))
    # the class list is one row a folder, so ranking it whole is small
    ids = rows.select("class_name").distinct().select("class_name", (F.row_number().over(Window.orderBy("class_name")) - 1).alias("class_id"))
    return rows.join(ids, "class_name").select("path", "class_name", "class_id", "size_bytes")


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a file, with the file it came from."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("file", F.input_file_name())


def csv_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def run_keys(file: Column, pattern: str, names: list[str]) -> list[Column]:
    """Keys from a path by a regex; null where it does not match."""
    return [F.when(F.regexp_extract(file, pattern, 0) != "", F.regexp_extract(file, pattern, k + 1)).alias(n) for k, n in enumerate(names)]


def log_curve(lines: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows, with the columns in ``keep``, of training log lines ``TRAIN|TEST Iter e: lr.., loss = x, Top-1 err = y, Top-5 err = z, train_time|val_time = s``."""
    pattern = r"(TRAIN|TEST)\s+Iter\s+(\d+):.*?loss = ([0-9.eE+-]+).*?Top-1 err = ([0-9.]+).*?Top-5 err = ([0-9.]+).*?(?:train_time|val_time) = ([0-9.]+)"
    part = lambda k: F.regexp_extract(text, pattern, k)
    rows = lines.where(F.col(text).rlike(pattern))
    return rows.select(*keep, F.lower(part(1)).alias("split"), part(2).cast("int").alias("epoch"), part(3).cast("double").alias("loss"), (100 - part(4).cast("double")).alias("top1"), (100 - part(5).cast("double")).alias("top5"), part(6).cast("double").alias("seconds"))


def prefixed_records(lines: DataFrame, schema: str, prefix: str = "RECOVERY_DIAG", text: str = "value") -> DataFrame:
    """``{json}`` or ``PREFIX {json}`` lines as typed columns; others are left out."""
    body = F.regexp_replace(F.trim(text), f"^{prefix} ", "")
    return lines.where(body.startswith("{")).select(F.from_json(body, schema).alias("r")).select("r.*")


def write_once(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet through Spark's committer; an existing target is refused."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def matrix(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A long table as a labelled matrix over the given columns."""
    return df.groupBy(row).pivot(column, columns).agg(F.first(value))


def markdown(rows: list[dict], columns: list[str], digits: int = 3) -> str:
    """A small report; null is a dash."""
    show = lambda x: "-" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return "\n".join([head, *("| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows)])


# ---- class lists ---------------------------------------------------------------------------------


def class_ids(names: DataFrame, name: str = "class_name") -> DataFrame:
    """``name, class_id``: the place of each name in the sorted list of distinct names. One row a class, so ranking it whole is small."""
    return names.select(name).where(F.col(name).isNotNull()).distinct().select(name, (F.row_number().over(Window.orderBy(name)) - 1).alias("class_id"))


def class_slice(listed: DataFrame, per_phase: int, phase: int, seed: int = 0, name: str = "class_name", place: str = "place") -> DataFrame:
    """``name, class_id`` of the ``phase``-th run of ``per_phase`` classes of a list; its order is that of ``place``, with a seed other than 0 that
    of a hash of seed and name. Ids count within the slice, in its order."""
    order = [F.col(place)] if seed == 0 else [fn.sampling_key(F.lit(seed), F.col(name)), F.col(name)]
    n = F.row_number().over(Window.orderBy(*order)) - 1
    ranked = listed.select(name, n.alias("n"))
    return ranked.where((F.col("n") >= per_phase * phase) & (F.col("n") < per_phase * (phase + 1))).select(name, (F.col("n") - per_phase * phase).alias("class_id"))


def first_shuffled(rows: DataFrame, per_class: int, seed: int, by: str, identity: str) -> DataFrame:
    """The first ``per_class`` rows of each class in hash order, with their 0-based slot."""
    order = Window.partitionBy(by).orderBy(fn.sampling_key(F.lit(seed), F.col(identity)), identity)
    return rows.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < per_class)


# ---- logs ----------------------------------------------------------------------------------------


def last_records(records: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Of records with the same keys the one on the last line; map-side combined."""
    values = [c for c in records.columns if c not in keys]
    last = records.groupBy(*keys).agg(F.max(F.struct(line, *(c for c in values if c != line))).alias("r"))
    return last.select(*keys, *(F.col(f"r.{c}").alias(c) for c in values))


def last_match(lines: DataFrame, pattern: str, by: str, line: str = "line", text: str = "value") -> DataFrame:
    """``by, found``: what the pattern's first group holds on the last line that matches, as a number; logs without a match are left out."""
    found = lines.where(F.col(text).rlike(pattern)).groupBy(by).agg(F.max(F.struct(line, text)).alias("r"))
    return found.select(by, F.regexp_extract(f"r.{text}", pattern, 1).cast("double").alias("found"))


def complete_series(points: DataFrame, by: str, length: int, tail: int = 10, at: str = "epoch", value: str = "loss") -> DataFrame:
    """``by, points, complete, final, tail_mean``: whether a log holds exactly the epochs 0 to ``length - 1`` (of repeated epochs the
    largest line counts once), its last value and the mean of the last ``tail``; both null where it is not complete."""
    g = points.groupBy(by).agg(
        F.count_distinct(at).alias("points"),
        ((F.count_distinct(at) == length) & (F.min(at) == 0) & (F.max(at) == length - 1)).alias("complete"),
        F.max(F.when(F.col(at) == length - 1, F.col(value))).alias("final"),
        F.avg(F.when(F.col(at) >= length - tail, F.col(value))).alias("tail_mean"),
    )
    return g.select(by, "points", "complete", *(F.when(F.col("complete"), F.col(c)).alias(c) for c in ("final", "tail_mean")))


def text_rows(lines: DataFrame, columns: list[str], numbers: int, text: str = "value") -> DataFrame:
    """Lines of blanks between an id, ``numbers`` numbers and the rest, by column name; lines with fewer fields give nulls, blank ones nothing."""
    parts = F.split(F.trim(F.col(text)), r"\s+", numbers + 2 if len(columns) > numbers + 1 else numbers + 1)
    cells = [F.get(parts, F.lit(k)) for k in range(len(columns))]
    typed = [c.try_cast("double") if 1 <= k <= numbers else c for k, c in enumerate(cells)]
    return lines.where(F.trim(F.col(text)) != "").select(*(c.alias(n) for c, n in zip(typed, columns, strict=True)))


# ---- feature and soft-label stores ---------------------------------------------------------------


def chunk_coverage(features: DataFrame, classes: int, per_chunk: int = 10, label: str = "class_id") -> DataFrame:
    """One row a chunk (``class // per_chunk``) with ``chunk, classes, rows_, missing, strays``: classes it lacks, and rows whose class is beyond the
    list. ``features`` may name a row's chunk in ``chunk``; a class found in another chunk than its own counts as a stray."""
    own = F.floor(F.col(label) / per_chunk).cast("int")
    named = features if "chunk" in features.columns else features.withColumn("chunk", own)
    right = (F.col("chunk") == own) & F.col(label).between(0, classes - 1)
    found = named.groupBy("chunk").agg(F.count_distinct(F.when(right, F.col(label))).alias("held"), F.count("*").alias("rows_"), F.count_if(~F.coalesce(right, F.lit(False))).alias("strays"))
    chunks = features.sparkSession.range(-(-classes // per_chunk)).select(F.col("id").cast("int").alias("c"), F.least(F.lit(per_chunk), F.lit(classes) - F.col("id") * per_chunk).cast("int").alias("due"))
    both = chunks.join(found, F.col("c") == F.col("chunk"), "full_outer")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return both.select(F.coalesce("c", "chunk").alias("chunk"), n("held").alias("classes"), n("rows_"), (F.coalesce("due", F.lit(0)) - F.coalesce("held", F.lit(0))).cast("long").alias("missing"), n("strays"))


def merge_shards(shards: DataFrame, keys: list[str], rank: str, place: str) -> DataFrame:
    """Shards of a distributed pass as one table: of rows with the same keys (samplers pad with repeats) the first by rank and place stays."""
    values = [c for c in shards.columns if c not in (*keys, rank, place)]
    first = shards.groupBy(*keys).agg(F.min(F.struct(rank, place, *values)).alias("r"))
    return first.select(*keys, *(F.col(f"r.{c}").alias(c) for c in (rank, place, *values)))


def store_info(batches: DataFrame, epoch: str = "epoch", batch: str = "batch") -> DataFrame:
    """One row about a soft-label store of one row a record: ``epochs``, ``contiguous`` (epochs are 0 to E - 1), ``batches`` and ``batch_size`` of epoch
    0, ``images`` (its full batches and the last one)."""
    sizes = batches.groupBy(epoch, batch).agg(F.count("*").alias("n"))
    first = F.col(epoch) == 0
    g = sizes.agg(
        F.count_distinct(epoch).alias("epochs"), (F.min(epoch) == 0).alias("from_0"), F.max(epoch).alias("top"), F.count_if(first).alias("batches"),
        F.min(F.when(first, F.struct(batch, "n")))["n"].alias("batch_size"), F.max(F.when(first, F.struct(batch, "n")))["n"].alias("last"),
    )
    whole = F.col("from_0") & (F.col("top") == F.col("epochs") - 1)
    return g.select("epochs", F.coalesce(whole, F.lit(False)).alias("contiguous"), "batches", "batch_size", (F.col("batch_size") * (F.col("batches") - 1) + F.col("last")).alias("images"))


def batch_records(store: DataFrame, asked: DataFrame, per_epoch: int, batch_size: int, epoch: str = "epoch", batch: str = "batch") -> DataFrame:
    """The records that a sampler asks for by ``epoch`` and its first image's place ``start``: batch ``start // batch_size``. An equi-join on the store's
    partition columns, so that other batches are pruned; a start beyond an epoch or inside a batch is refused (no record)."""
    good = (F.col("start") % batch_size == 0) & F.col("start").between(0, per_epoch - 1)
    wanted = asked.where(good).select(F.col("epoch").alias("a_epoch"), "start", F.floor(F.col("start") / batch_size).cast("int").alias("a_batch"))
    return store.join(wanted, (F.col(epoch) == F.col("a_epoch")) & (F.col(batch) == F.col("a_batch"))).drop("a_epoch", "a_batch")


def read_through(spark: SparkSession, path: str, make, schema: StructType | str) -> DataFrame:
    """The table at ``path`` where it was written whole, else ``make()`` written there first; a folder that was not written whole is set aside,
    never deleted."""
    from .files import set_aside

    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        rows = make()
        set_aside(spark, path)
        rows.write.mode("errorifexists").parquet(path)
    return spark.read.schema(schema).parquet(path)


# ---- materialised selections ---------------------------------------------------------------------


def target_plan(selection: DataFrame, present: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """What writing a selection into a folder would do: ``target, source, state``. ``new`` is to be written; ``same`` is there from the same
    source; ``collision`` is two sources for a target, or one there from another source; ``extra`` is there but not selected.
    ``present`` has the files that are there, with the sources they came from."""
    wanted = selection.groupBy(target).agg(F.min(source).alias("s"), F.count_distinct(source).alias("n"))
    have = present.select(F.col(target).alias("h_target"), F.col(source).alias("h_source"))
    both = wanted.join(have, F.col(target) == F.col("h_target"), "full_outer")
    state = F.when(F.col(target).isNull(), "extra").when((F.col("n") > 1) | (F.col("h_target").isNotNull() & ~F.col("s").eqNullSafe(F.col("h_source"))), "collision").when(F.col("h_target").isNotNull(), "same").otherwise("new")
    return both.select(F.coalesce(target, "h_target").alias(target), F.coalesce("s", "h_source").alias(source), state.alias("state"))


def rows_as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object with its keys in order, for ``write.text``."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def rows_as_csv(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as one line of CSV over the given columns; null is empty."""
    return df.select(F.to_csv(F.struct(*columns), {"nullValue": "", "emptyValue": ""}).alias("value"))


def report_rows(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """Each row as a line of a Markdown table; numbers with fixed decimals, null as a dash."""
    kinds = dict(df.dtypes)
    shown = [F.coalesce(F.format_string(f"%.{digits}f", c) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit("-")) for c in columns]
    shown = [F.when(F.col(c).isNull(), "-").otherwise(s) for c, s in zip(columns, shown, strict=True)]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("line"))
