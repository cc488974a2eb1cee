"""The streaming forms on files that arrive one after another, against the batch operators."""

import datetime as dt
import math

from pyspark.sql import functions as F

from quillmere import streaming

SCHEMA = "k int, ts timestamp, value double"


def arriving(spark, folder, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def finished(stream, folder, mode="append"):
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination(120)


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, minutes=minute)


def test_windowed_moments(spark, tmp_path):
    batches = [[(k % 3, at(h, 7 * k), float(k * h + 1)) for k in range(8)] for h in range(6)] + [[(9, at(30), 0.0)]]  # the last moves the watermark on
    finished(streaming.windowed_moments(arriving(spark, tmp_path, batches), "k"), tmp_path)
    parts = spark.read.parquet(f"{tmp_path}/out")
    rows = [r for b in batches[:-1] for r in b]
    for r in parts.collect():
        mine = [v for k, t, v in rows if k == r.k and t.replace(minute=0) == r.start.replace(tzinfo=None)]
        assert r.n == len(mine) and math.isclose(r.s, sum(mine)) and math.isclose(r.q, sum(v * v for v in mine))
    merged = {r.k: r for r in streaming.moments(parts, "k").collect()}
    for k in range(3):
        mine = [v for j, _, v in rows if j == k]
        mean = sum(mine) / len(mine)
        assert merged[k].n == len(mine) and math.isclose(merged[k]["mean"], mean) and math.isclose(merged[k].sd, math.sqrt(sum((v - mean) ** 2 for v in mine) / len(mine)))


def test_first_of_each(spark, tmp_path):
    batches = [[(k, at(h, k), float(h)) for k in range(5)] for h in (0, 0, 1)]
    finished(streaming.first_of_each(arriving(spark, tmp_path, batches), ["k"]), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 5 and got.agg(F.count_distinct("k")).first()[0] == 5
