"""Lines with their numbers, members of large archives, and selections written as files."""

from __future__ import annotations

import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

from ..tables import written
from .soft_labels import opened


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value`` of text files, lines numbered from 1. Files are read in splits; a pass counts each split's lines, and a line's number is
    its place in the split after the lines of the splits before it."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = raw.groupBy("file", "block").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", "low", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("low") + 1).alias("line"), "value")


def strict_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The columns of ``schema`` with ``file`` and ``line``. Blank lines are skipped, though counted; a line that is no object of the schema fails the
    read with its file and number."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = StructType([*kind.fields]).add("_bad", StringType())
    lines = numbered_lines(spark, path).where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    parsed = lines.select("file", "line", F.from_json("value", whole, {"columnNameOfCorruptRecord": "_bad"}).alias("r"), F.trim("value").alias("value"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.startswith("value", F.lit("{"))
    told = F.raise_error(F.concat(F.lit("not a JSON object of the schema: "), "file", F.lit(" line "), F.col("line").cast("string"))).cast("long")
    return parsed.select(*(F.col("r")[f.name].alias(f.name) for f in kind.fields), "file", F.when(bad, told).otherwise(F.col("line")).alias("line"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """``archive, name, size_bytes, packed_bytes`` of the files in zip archives, from their central directories alone; an archive may be of any size."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive in pdf["path"]:
                where, inside = opened(archive)
                with where.open_input_file(inside) as f, zipfile.ZipFile(f) as z:
                    rows = [(archive, i.filename, i.file_size, i.compress_size) for i in z.infolist() if not i.is_dir()]
                yield pd.DataFrame(rows, columns=["archive", "name", "size_bytes", "packed_bytes"])

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(members, "archive string, name string, size_bytes long, packed_bytes long")


def archive_contents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), bytes_a_task: int = 64 << 20) -> DataFrame:
    """``archive, name, size_bytes, content``: members are dealt to tasks of about ``bytes_a_task`` packed bytes and read from their own stretch of the
    archive, one at a time."""
    wanted = archive_members(spark, path)
    if suffixes:
        wanted = wanted.where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*(s.lower().lstrip(".") for s in suffixes)))
    tasks = max(1, -(-(wanted.agg(F.sum("packed_bytes")).first()[0] or 0) // bytes_a_task))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, z = None, None
        for batch in batches:
            for archive, name, size in zip(*(batch.column(c).to_pylist() for c in ("archive", "name", "size_bytes"))):
                if archive != held:
                    where, inside = opened(archive)
                    held, z = archive, zipfile.ZipFile(where.open_input_file(inside))
                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([name]), pa.array([size], pa.int64()), pa.array([z.read(name)], pa.binary())], names=["archive", "name", "size_bytes", "content"])

    dealt = wanted.repartition(tasks, "archive", "name").sortWithinPartitions("archive", "name")
    return dealt.select("archive", "name", "size_bytes").mapInArrow(contents, "archive string, name string, size_bytes long, content binary")


# ---- selections as files -------------------------------------------------------------------------


def local(path: str) -> str:
    """A path of a shared file system that is mounted on every machine; links need one."""
    if path.startswith("file:"):
        return unquote(urlparse(path).path)
    if "://" in path:
        raise ValueError(f"links and copies need a mounted path: {path}")
    return path


def _state(source: str, target: str) -> str:
    """What is in the target's place: nothing (``new``), the source itself or a copy of it (``same``), or something else."""
    if not os.path.lexists(target):
        return "new" if os.path.isfile(source) else "no source"
    if not os.path.exists(target) or not os.path.isfile(source):
        return "other"
    if os.path.samefile(source, target):
        return "same"
    if os.path.getsize(source) != os.path.getsize(target):
        return "other"
    with open(source, "rb") as a, open(target, "rb") as b:
        while chunk := a.read(1 << 20):
            if chunk != b.read(1 << 20):
                return "other"
    return "same"


def _place(source: str, target: str, how: str) -> None:
    """The target made beside its place and moved there at once, so that a task that runs twice, or dies, leaves a whole file or none."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    beside = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}.part")
    try:
        {"copy": shutil.copyfile, "hardlink": os.link, "symlink": os.symlink}[how](source, beside)
        os.replace(beside, target)
    finally:
        if os.path.lexists(beside):
            os.remove(beside)  # a link moved onto the same file stays where it was


def _tree(spark: SparkSession, root: str) -> DataFrame:
    """``target`` of every file below ``root``, one folder of the top a task."""
    top = sorted(os.listdir(root)) if os.path.isdir(root) else []
    names = spark.createDataFrame([(t,) for t in top], "top string").repartition(max(1, min(len(top), 256)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf["top"]:
                at = os.path.join(root, t)
                files = [os.path.join(d, f) for d, _, names in os.walk(at) for f in names] if os.path.isdir(at) and not os.path.islink(at) else [at]
                yield pd.DataFrame({"target": [os.path.relpath(f, root) for f in files]})

    return names.mapInPandas(walk, "target string")


def write_selection(selection: DataFrame, root: str, how: str = "copy") -> DataFrame:
    """Write ``selection`` (``source``, and ``target`` below ``root``) as copies or links; gives ``target, source, state`` of each, ``new`` or ``same``.

    Everything is decided before anything is written: two sources for a target, a target that holds something else, a missing source, a target outside
    the root, or files there that are not selected raise ``ValueError`` and leave the folder as it was. Files that are there already stay."""
    if how not in ("copy", "hardlink", "symlink"):
        raise ValueError(f"unknown way to write: {how}")
    root = local(root)
    spark = selection.sparkSession
    wanted = selection.groupBy("target").agg(F.min("source").alias("source"), F.count_distinct("source").alias("n"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            states = []
            for source, target, n in zip(pdf["source"], pdf["target"], pdf["n"]):
                inside = bool(target) and not os.path.isabs(target) and not os.path.normpath(target).startswith("..")
                states.append("no source" if source is None else "two sources" if n > 1 else "outside" if not inside else _state(local(source), os.path.join(root, target)))
            yield pdf[["target", "source"]].assign(state=states)

    plan = written(wanted.mapInPandas(judge, "target string, source string, state string"), "selection-plan")
    extra = _tree(spark, root).join(wanted.select("target"), "target", "left_anti").select("target", F.lit(None).cast("string").alias("source"), F.lit("not selected").alias("state"))
    faults = plan.where(~F.col("state").isin("new", "same")).unionByName(extra).orderBy("target").limit(20).collect()
    if faults:
        raise ValueError("nothing written: " + "; ".join(f"{r['target']}: {r['state']}" for r in faults))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source, target in zip(pdf["source"], pdf["target"]):
                _place(os.path.abspath(local(source)), os.path.join(root, target), how)
            yield pdf

    done = written(plan.where("state = 'new'").mapInPandas(place, "target string, source string, state string"), "selection-done")
    return done.unionByName(plan.where("state = 'same'"))


def set_aside(spark: SparkSession, path: str) -> str | None:
    """Move what is at ``path`` to the first free ``path.invalid-N`` and give that name; nothing is deleted. None where nothing is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    where = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not where.exists(target):
        return None
    n = 0
    while where.exists(aside := spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.invalid-{n}")):
        n += 1
    if not where.rename(target, aside):
        raise OSError(f"could not move {path}")
    return f"{path.rstrip('/')}.invalid-{n}"
