"""What several corpus operators need: a shared scratch folder, row keys, bounded batches, and
connected components as a Spark job."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text that a task works on at once: what it makes of it is a multiple of that, and each core of an executor has a task.
CHUNK_BYTES = 2 << 20

_own_folder: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one in ``spark.checkpoint.dir``; only where that
    is unset (tests on one machine) a temporary folder of this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-scratch-"))
    return _own_folder[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back. This cuts the lineage and survives
    the loss of executors, and unlike ``checkpoint()`` computes the rows only once."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and of which nothing is read any more: all that was made of them must be written."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def row_key(text: str = "text") -> F.Column:
    """With the document's id this tells rows apart even where ids repeat: equal pairs are equal texts
    (up to a 64-bit collision between two texts of the same id)."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def text_chunks(batches: Iterator[pa.RecordBatch], max_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of whole rows with about ``max_bytes`` of text; a longer text
    makes a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system. Workers are kept from task to task, and an allocator's leftovers of one add up with the next one's needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when a task's rows are through and what it remembered is gone, its memory is given back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def hash_cut(n: int, wanted: int) -> int:
    """Below this about twice ``wanted`` of ``n`` even 64-bit hashes lie; all of them where there are no more."""
    return min((1 << 63) - 1, -(1 << 63) + (2 * wanted << 64) // max(1, n)) if 2 * wanted < n else (1 << 63) - 1


def bounded_rows(rows: DataFrame, most: int, by: str | None = None) -> DataFrame:
    """``rows`` (``text`` and others) where they are at most ``most``; else exactly bounded: one row of each of the ``most`` distinct texts with
    the smallest hashes. With ``by`` each of its values has an equal share of ``most``, at least one text, so that a rare one is not
    lost. Copies count once, whatever their number; the draw is the same every time. Null texts and values must be left out before.

    A first cut by hash, from counts of distinct texts, keeps about twice the rows wanted; only these are shuffled and ranked.
    """
    h = F.xxhash64("text")
    group = F.col(by) if by else F.lit(0)
    found = rows.groupBy(group.alias("g")).agg(F.count("*").alias("n"), F.approx_count_distinct(h).alias("texts")).orderBy(F.desc("n"), "g").limit(most).collect()
    if sum(r.n for r in found) <= most:
        return rows
    share = max(1, most // max(1, len(found)))
    cuts = F.create_map(*(F.lit(x) for r in found for x in (r.g, hash_cut(r.texts, share))))
    near = rows.select("*", group.alias("_group"), h.alias("_hash")).where(F.col("_hash") <= F.coalesce(cuts[F.col("_group")], F.lit(-(1 << 63))))
    one = near.dropDuplicates(["_group", "_hash"])
    rank = F.row_number().over(Window.partitionBy("_group").orderBy("_hash"))
    return one.withColumn("_rank", rank).where(F.col("_rank") <= share).drop("_group", "_hash", "_rank")


def bounded_ids(labels: DataFrame, most: int, identity: str = "doc_id") -> DataFrame:
    """At most ``most`` rows of ``labels``, those with the smallest hashes of their id: small enough to broadcast, whatever repeats."""
    labels = labels.where(F.col(identity).isNotNull())
    cut = hash_cut(labels.agg(F.approx_count_distinct(identity)).first()[0], most)
    return labels.where(F.xxhash64(identity) <= cut).orderBy(F.xxhash64(identity), *labels.columns).limit(most)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """``(id, component)`` for every node of ``edges``: component is the smallest id reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Every step is a
    map-side combined ``min`` and a join of two written tables, so Spark can split a hub's partition; nothing is
    collected but two numbers a round. Null ids and loops are left out.
    """
    step = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    step = materialize(step, name)
    seen = None
    while True:
        # large star: each node hangs its larger neighbours on the smallest node it sees
        both = step.select("u", "v").unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least_of_larger = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialize(large, name)
        # small star: each node hangs itself and its smaller neighbours on the smallest of them
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        step, before = materialize(small, name), step
        discard(before, least_of_larger, large, low)
        now = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = step.select(F.col("v").alias("id")).distinct()
    return step.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
