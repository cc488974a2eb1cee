"""A store of soft labels that one opens by path: ``spark.read.format("soft_labels").load(path)``.

One Arrow file holds one batch of one epoch, ``epoch=E/batch=B.arrow``, and each epoch's ``_batches.json`` lists its batches with their rows. Only
what is listed is in the store: a write works in a folder of its own, and the list is replaced when all of it has succeeded, so a
write that dies leaves a store as it was. Filters on ``epoch`` and ``batch`` choose files before any is opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Batches that one read task opens, one after another.
BATCHES_A_TASK = 16
_TESTS = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read_json(where: fs.FileSystem, path: str):
    with where.open_input_file(path) as f:
        return json.loads(f.read())


def _write_json(where: fs.FileSystem, path: str, value) -> None:
    """Whole or not at all: written beside its place and moved there."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with where.open_output_stream(beside) as f:
        f.write(json.dumps(value).encode())
    where.move(beside, path)


def _epochs(where: fs.FileSystem, root: str) -> list[int]:
    found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(int(f.base_name[6:]) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("epoch="))


def _listed(where: fs.FileSystem, root: str, epoch: int) -> dict[int, list]:
    """``{batch: [file, rows]}`` of an epoch."""
    path = f"{root}/epoch={epoch}/_batches.json"
    return {int(b): x for b, x in _read_json(where, path).items()} if where.get_file_info(path).type == fs.FileType.File else {}


@dataclass
class _Batches(InputPartition):
    files: list  # epoch, batch, file


@dataclass
class _Written(WriterCommitMessage):
    files: list  # epoch, batch, file, rows


class SoftLabels(DataSource):
    @classmethod
    def name(cls) -> str:
        return "soft_labels"

    def schema(self) -> StructType:
        where, root = opened(self.options["path"])
        return StructType.fromJson(_read_json(where, f"{root}/_schema.json"))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("batchesPerTask", BATCHES_A_TASK)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, per_task: int):
        self.path, self.names, self.per_task, self.tests = path, schema.fieldNames(), per_task, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("epoch",), ("batch",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _wanted(self, column: str, value: int) -> bool:
        return all(_TESTS[kind](value, v) for c, kind, v in self.tests if c == column)

    def partitions(self) -> list[_Batches]:
        where, root = opened(self.path)
        files = [(e, b, name) for e in _epochs(where, root) if self._wanted("epoch", e) for b, (name, _) in sorted(_listed(where, root, e).items()) if self._wanted("batch", b)]
        return [_Batches(files[k : k + self.per_task]) for k in range(0, len(files), self.per_task)] or [_Batches([])]

    def read(self, partition: _Batches) -> Iterator[pa.RecordBatch]:
        where, root = opened(self.path)
        for epoch, batch, name in partition.files:
            with where.open_input_file(f"{root}/epoch={epoch}/{name}") as f, pa.ipc.open_file(f) as records:
                for k in range(records.num_record_batches):
                    rows = records.get_batch(k)
                    own = {"epoch": pa.array([epoch] * len(rows), pa.int32()), "batch": pa.array([batch] * len(rows), pa.int32())}
                    yield pa.RecordBatch.from_arrays([own[c] if c in own else rows.column(c) for c in self.names], names=self.names)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite, self.job = path, schema, overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """One file for each batch of each epoch that the task meets in order; a retried task writes under other names."""
        where, root = opened(self.path)
        where.create_dir(f"{root}/{self.job}", recursive=True)
        files, now, sink, out = [], None, None, None

        def close():
            if out:
                out.close()
                sink.close()

        for rows in iterator:
            table, start = pa.Table.from_batches([rows]), 0
            keys = list(zip(table.column("epoch").to_pylist(), table.column("batch").to_pylist()))
            body = table.drop_columns(["epoch", "batch"])
            while start < len(keys):
                end = start
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if keys[start] != now:
                    close()
                    now, name = keys[start], f"{uuid.uuid4().hex}.arrow"
                    if None in now:
                        raise ValueError("a soft label needs an epoch and a batch")
                    sink = where.open_output_stream(f"{root}/{self.job}/{name}")
                    out = pa.ipc.new_file(sink, body.schema)
                    files.append([*now, name, 0])
                out.write_table(body.slice(start, end - start))
                files[-1][3] += end - start
                start = end
        close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        where, root = opened(self.path)
        made: dict[int, dict[int, list]] = {}
        for epoch, batch, name, rows in (x for m in messages if m for x in m.files):
            if batch in made.setdefault(epoch, {}):
                self.abort(messages)
                raise ValueError(f"batch {batch} of epoch {epoch} comes from two tasks: deal rows by epoch and batch, sorted")
            made[epoch][batch] = [name, rows]
        before = {e: {} if self.overwrite else _listed(where, root, e) for e in made}
        twice = sorted((e, b) for e in made for b in made[e] if b in before[e])
        if twice:
            self.abort(messages)
            raise ValueError(f"already in the store: {twice[:20]}")
        old = _epochs(where, root) if self.overwrite else []
        where.create_dir(root, recursive=True)
        _write_json(where, f"{root}/_schema.json", self.schema.jsonValue())
        for epoch, batches in sorted(made.items()):
            where.create_dir(f"{root}/epoch={epoch}", recursive=True)
            for batch, (name, rows) in batches.items():
                where.move(f"{root}/{self.job}/{name}", f"{root}/epoch={epoch}/batch={batch}-{name}")
                before[epoch][batch] = [f"batch={batch}-{name}", rows]
            _write_json(where, f"{root}/epoch={epoch}/_batches.json", before[epoch])
        for epoch in set(old) - set(made):
            where.delete_dir(f"{root}/epoch={epoch}")
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        where, root = opened(self.path)
        if where.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{self.job}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SoftLabels)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_soft_labels(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """``df`` (``epoch``, ``batch``, ``place`` and any others) as a store, each batch in order of ``place``; batches that are there already are refused,
    with ``overwrite`` the store is replaced."""
    register(df.sparkSession)
    typed = df.withColumn("epoch", F.col("epoch").cast("int")).withColumn("batch", F.col("batch").cast("int"))
    dealt = typed.repartition("epoch", "batch").sortWithinPartitions("epoch", "batch", "place")
    dealt.write.format("soft_labels").mode("overwrite" if overwrite else "append").save(path)


def read_soft_labels(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("soft_labels").options(**options).load(path)


def soft_label_batch(spark: SparkSession, path: str, epoch: int, start: int) -> DataFrame:
    """The records of the batch of ``epoch`` whose first image is in place ``start``; no record where no batch starts there. Sizes come from the
    list of batches, so one file is opened."""
    where, root = opened(path)
    sizes, at = _listed(where, root, epoch), 0
    for batch in sorted(sizes):
        if at == start:
            return read_soft_labels(spark, path).where((F.col("epoch") == epoch) & (F.col("batch") == batch))
        at += sizes[batch][1]
    return read_soft_labels(spark, path).where(F.lit(False))
