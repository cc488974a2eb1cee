"""Readers, parsers and writers on small files, against what plain Python reads."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmere import sources as src
from quillmere.sources import files
from quillmere.sources import soft_labels as soft


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_class_folders(spark, tmp_path):
    for name, files in {"b_dog": ["1.JPG", "2.png", "note.txt"], "a_cat": ["x.jpeg"], "c_empty": []}.items():
        (tmp_path / name).mkdir()
        for f in files:
            (tmp_path / name / f).write_bytes(b"12345")
    found = src.class_folders(spark, str(tmp_path))
    assert rows(found, "class_name", "class_id", "size_bytes") == [("a_cat", 0, 5), ("b_dog", 1, 5), ("b_dog", 1, 5)]


def test_class_lists(spark):
    names = spark.createDataFrame([(n, k) for k, n in enumerate("pug cat ant bee dog cow".split())], "class_name string, place int")
    assert rows(src.class_slice(names, 2, 1), "class_id", "class_name") == [(0, "ant"), (1, "bee")]
    seeded = [r.class_name for k in range(3) for r in sorted(src.class_slice(names, 2, k, seed=3).collect(), key=lambda r: r.class_id)]
    assert sorted(seeded) == sorted("pug cat ant bee dog cow".split()) and seeded != "pug cat ant bee dog cow".split()
    assert rows(src.class_ids(names.unionByName(names)), "class_name", "class_id") == [(n, k) for k, n in enumerate(sorted("pug cat ant bee dog cow".split()))]
    assert src.class_slice(names, 2, 9).count() == 0


def test_json_and_csv(spark, tmp_path):
    for k in range(2):
        run = tmp_path / f"arm{k}_s{k + 3}"
        run.mkdir()
        (run / "result.json").write_text(json.dumps({"top1": 50.5 + k, "per_class": [{"class_id": 0, "total": 2}]}, indent=1))
    docs = src.json_documents(spark, f"{tmp_path}/*/result.json", "top1 double, per_class array<struct<class_id: int, total: int>>")
    keyed = docs.select("top1", *src.run_keys(F.col("file"), r"arm(\d+)_s(\d+)", ["arm", "seed"]))
    assert rows(keyed, "arm", "seed", "top1") == [("0", "3", 50.5), ("1", "4", 51.5)]
    assert rows(docs.select(*src.run_keys(F.col("file"), r"nothing(\d)", ["arm"])), "arm") == [(None,), (None,)]
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": oops\n')
    assert rows(files.strict_json_lines(spark, f"{tmp_path}/good.jsonl", "a int"), "a", "line") == [(1, 1), (2, 3)]
    with pytest.raises(Exception, match="bad.jsonl line 2"):
        files.strict_json_lines(spark, f"{tmp_path}/bad.jsonl", "a int").collect()
    (tmp_path / "t.csv").write_text("name,gain\nx,1.5\ny,\n")
    assert rows(src.csv_rows(spark, f"{tmp_path}/t.csv", "name string, gain double"), "name", "gain") == [("x", 1.5), ("y", None)]


LOG = """start
TRAIN Iter 0: lr = 0.1, loss = 2.500000, Top-1 err = 80.0, Top-5 err = 40.0, train_time = 12.5
TEST Iter 0: loss = 2.0e0, Top-1 err = 70.25, Top-5 err = 30.0, val_time = 3.5
TEST Iter 1: loss = 1.0, Top-1 err = 60.0, Top-5 err = 20.0, val_time = 3.5
"""


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    lines = spark.read.text(f"{tmp_path}/a.log").withColumn("line", F.monotonically_increasing_id()).withColumn("log", F.lit("a"))
    assert rows(src.log_curve(lines), "split", "epoch", "loss", "top1", "top5", "seconds") == [("test", 0, 2.0, 29.75, 70.0, 3.5), ("test", 1, 1.0, 40.0, 80.0, 3.5), ("train", 0, 2.5, 20.0, 60.0, 12.5)]
    assert rows(src.last_match(lines, r"TEST Iter .*?Top-1 err = ([0-9.]+)", "log"), "log", "found") == [("a", 60.0)]
    assert src.last_match(lines, r"absent ([0-9])", "log").count() == 0


def test_records_last_wins(spark):
    lines = spark.createDataFrame([('RECOVERY_DIAG {"batch": 1, "ce": 2.0, "line": 1}',), ('{"batch": 1, "ce": 1.5, "line": 2}',), ("plain",), ('RECOVERY_DIAG {"batch": 2, "ce": 9.0, "line": 3}',), ("",), (None,)], "value string")
    found = src.last_records(src.prefixed_records(lines, "batch int, ce double, line long"), ["batch"])
    assert rows(found, "batch", "ce") == [(1, 1.5), (2, 9.0)]


def test_complete_series(spark):
    points = [("whole", e, e / 10) for e in range(20)] + [("short", e, 1.0) for e in range(19)] + [("late", e, 1.0) for e in range(1, 21)] + [("twice", e, 2.0) for e in range(20)] + [("twice", 3, 2.0)]
    got = {r.log: (r.points, r.complete, r.final, r.tail_mean) for r in src.complete_series(spark.createDataFrame(points, "log string, epoch int, loss double"), "log", 20).collect()}
    assert got["whole"][:3] == (20, True, 1.9) and abs(got["whole"][3] - 1.45) < 1e-12
    assert got["short"] == (19, False, None, None) and got["late"] == (20, False, None, None) and got["twice"][1]


def test_text_rows(spark):
    lines = spark.createDataFrame([("7 1.5 2  the rest of it",), ("8 3 x",), ("  ",), ("9",)], "value string")
    assert sorted(tuple(r) for r in src.text_rows(lines, ["id", "a", "b", "rest"], 2).collect()) == [("7", 1.5, 2.0, "the rest of it"), ("8", 3.0, None, None), ("9", None, None, None)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """Two files cut into splits of a few lines; blank lines count, a bad line in the middle of one is named."""
    for name, n in (("a", 4_000), ("b", 1_500)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join("" if k % 7 == 0 else json.dumps({"v": k, "pad": "x" * (k % 50)}) for k in range(1, n + 1)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = files.strict_json_lines(spark, str(tmp_path), "v long")
        assert df.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = [(r.file.rsplit("/", 1)[1], r.line, r.v) for r in df.collect()]
        assert sorted(got) == sorted((f"{name}.jsonl", k, k) for name, n in (("a", 4_000), ("b", 1_500)) for k in range(1, n + 1) if k % 7)
        with (tmp_path / "b.jsonl").open("a") as f:
            f.write('\n[1, 2]\n{"v": 1}')
        with pytest.raises(Exception, match="b.jsonl line 1501"):
            files.strict_json_lines(spark, str(tmp_path), "v long").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_archives_by_member(spark, tmp_path):
    """One archive lies behind more than 2 GB (a hole, so that it takes no room) and is read by several tasks."""
    with (tmp_path / "one.zip").open("wb") as f:
        f.truncate((2 << 30) + 4096)
    for name in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "a", zipfile.ZIP_DEFLATED) as z:
            for k in range(12):
                z.writestr(f"{name}/{k}.JPG", bytes([k]) * 5_000)
            z.writestr("readme.txt", "text")
    assert (tmp_path / "one.zip").stat().st_size > 2 << 30
    found = files.archive_contents(spark, str(tmp_path), (".jpg",), bytes_a_task=100)
    assert found.rdd.getNumPartitions() > 4
    assert rows(found, "name", "size_bytes", "content") == sorted((f"{name}/{k}.JPG", 5_000, bytes([k]) * 5_000) for name in ("one", "two") for k in range(12))
    assert found.select("archive", F.spark_partition_id().alias("p")).where("archive like '%one.zip'").distinct().count() > 3
    assert files.archive_members(spark, str(tmp_path)).count() == 26


def store_rows(spark, epochs=3, sizes=(8, 8, 5), add=0):
    return spark.createDataFrame([(e, b, k, e * 100 + b * 10 + k + add, [0.25, 0.75]) for e in range(epochs) for b, n in enumerate(sizes) for k in range(n)], "epoch int, batch int, place int, image long, p array<double>")


def test_soft_label_store(spark, tmp_path):
    path = f"{tmp_path}/store"
    df = store_rows(spark)
    soft.write_soft_labels(df, path)
    back = soft.read_soft_labels(spark, path, batchesPerTask="2")
    assert back.columns == df.columns and rows(back, *df.columns) == rows(df, *df.columns)
    assert tuple(src.store_info(back).first()) == (3, True, 3, 8, 21)
    # a lookup opens its own batch and no other: the others are spoilt
    kept = json.loads((tmp_path / "store/epoch=1/_batches.json").read_text())["2"][0]
    for f in (tmp_path / "store").glob("epoch=*/*.arrow"):
        if not (f.parent.name == "epoch=1" and f.name == kept):
            f.write_bytes(b"spoilt")
    assert rows(soft.soft_label_batch(spark, path, 1, 16), "place", "image") == [(k, 120 + k) for k in range(5)]
    assert soft.read_soft_labels(spark, path).where("epoch in (1) and batch >= 2 and image > 122").count() == 2
    assert soft.soft_label_batch(spark, path, 1, 3).count() == 0 and soft.soft_label_batch(spark, path, 9, 0).count() == 0
    with pytest.raises(Exception):
        soft.read_soft_labels(spark, path).count()


def test_soft_label_writes_are_whole_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/store"
    soft.write_soft_labels(store_rows(spark, 1), path)
    before = {f: f.read_bytes() for f in (tmp_path / "store").rglob("*") if f.is_file()}
    dies = store_rows(spark, 3).where("epoch > 0").withColumn("image", F.when(F.col("image") == 214, F.raise_error(F.lit("dies")).cast("long")).otherwise(F.col("image")))
    with pytest.raises(Exception, match="dies"):
        soft.write_soft_labels(dies, path)
    with pytest.raises(Exception, match="already in the store"):
        soft.write_soft_labels(store_rows(spark, 2), path)
    assert {f: f.read_bytes() for f in (tmp_path / "store").rglob("*") if f.is_file()} == before
    soft.register(spark)
    split = store_rows(spark, 2).where("epoch = 1").repartition(3, "place")
    with pytest.raises(Exception, match="two tasks"):
        split.write.format("soft_labels").mode("append").save(path)
    assert not [f for f in (tmp_path / "store").iterdir() if f.name.startswith("_writing")]
    soft.write_soft_labels(store_rows(spark, 3).where("epoch > 0"), path)
    assert soft.read_soft_labels(spark, path).count() == 63
    soft.write_soft_labels(store_rows(spark, 1, (4,), 7), path, overwrite=True)
    assert rows(soft.read_soft_labels(spark, path), "epoch", "image") == [(0, 7 + k) for k in range(4)]


@pytest.mark.parametrize("how", ["copy", "hardlink", "symlink"])
def test_selections_are_written(spark, tmp_path, how):
    (tmp_path / "in").mkdir()
    for k in range(6):
        (tmp_path / f"in/{k}.jpg").write_text(f"image {k}")
    chosen = [(f"{tmp_path}/in/{k}.jpg", f"class_{k % 2}/{k}.jpg") for k in range(4)]
    out = tmp_path / "out"
    write = lambda pairs: rows(files.write_selection(spark.createDataFrame(pairs, "source string, target string"), str(out), how), "target", "state")
    tree = lambda: {str(f.relative_to(out)): f.read_text() for f in out.rglob("*") if f.is_file()}
    assert write(chosen) == sorted((t, "new") for _, t in chosen)
    want = {t: f"image {k}" for k, (_, t) in enumerate(chosen)}
    assert tree() == want
    first = out / chosen[0][1]
    assert first.is_symlink() == (how == "symlink") and (first.stat().st_nlink > 1) == (how == "hardlink")
    assert write(chosen) == sorted((t, "same") for _, t in chosen)  # again: nothing to do
    (out / chosen[1][1]).unlink()  # one is lost: only it is written
    assert dict(write(chosen))[chosen[1][1]] == "new" and tree() == want
    files._place(chosen[0][0], str(first), how)  # a task that runs twice
    assert tree() == want
    for pairs, fault in (
        ([*chosen, (chosen[0][0], chosen[1][1])], "two sources"),
        (chosen[1:], "not selected"),
        ([*chosen, (f"{tmp_path}/in/none.jpg", "class_0/9.jpg")], "no source"),
        ([*chosen, (f"{tmp_path}/in/5.jpg", "../5.jpg")], "outside"),
        ([*chosen[1:], (f"{tmp_path}/in/5.jpg", chosen[0][1])], "other"),
    ):
        with pytest.raises(ValueError, match=fault):
            write([*pairs, (f"{tmp_path}/in/4.jpg", "class_0/4.jpg")])
        assert tree() == want and not (tmp_path / "5.jpg").exists()


def test_feature_chunks(spark):
    whole = spark.range(200).select((F.col("id") % 25).cast("int").alias("class_id"))
    assert rows(src.chunk_coverage(whole, 25), "chunk", "classes", "missing", "strays") == [(0, 10, 0, 0), (1, 10, 0, 0), (2, 5, 0, 0)]
    odd = spark.createDataFrame([(0, 0), (0, 1), (11, 1), (40, 4)], "class_id int, chunk int")
    assert rows(src.chunk_coverage(odd, 20), "chunk", "classes", "rows_", "missing", "strays") == [(0, 1, 1, 9, 0), (1, 1, 2, 9, 1), (4, 0, 1, 0, 1)]


def test_shards_first_wins(spark):
    shards = spark.createDataFrame([("a", 1, 0, 5), ("a", 0, 3, 6), ("a", 0, 1, 7), ("b", 1, 1, 8)], "path string, rank int, place int, feature int")
    assert rows(src.merge_shards(shards, ["path"], "rank", "place"), "path", "feature") == [("a", 7), ("b", 8)]


def test_soft_label_store(spark):
    store = spark.createDataFrame([(e, b, k) for e in range(3) for b in range(4) for k in range(8 if b < 3 else 5)], "epoch int, batch int, row_ int")
    assert tuple(src.store_info(store).first()) == (3, True, 4, 8, 29)
    assert src.store_info(store.where("epoch <> 1")).first().contiguous is False
    assert src.store_info(store.limit(0)).first().contiguous is False
    asked = spark.createDataFrame([(1, 24), (2, 0), (2, 3), (0, 64)], "epoch int, start int")
    assert rows(src.batch_records(store, asked, 29, 8), "epoch", "start", "row_") == [(1, 24, k) for k in range(5)] + [(2, 0, k) for k in range(8)]


def test_written_once_and_read_through(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    src.write_once(df, f"{tmp_path}/t", ("k",))
    with pytest.raises(Exception, match="exists"):
        src.write_once(df, f"{tmp_path}/t")
    made = []
    make = lambda: made.append(1) or df
    for _ in range(2):
        assert rows(src.read_through(spark, f"{tmp_path}/cache", make, df.schema), "k", "v") == [(1, "a"), (2, "b")]
    assert len(made) == 1
    # a folder that was not written whole is set aside, with what is in it
    for n in range(2):
        (tmp_path / "cache/_SUCCESS").unlink()
        (tmp_path / "cache/mine.txt").write_text(f"keep {n}")
        assert src.read_through(spark, f"{tmp_path}/cache", make, df.schema).count() == 2
        assert (tmp_path / f"cache.invalid-{n}/mine.txt").read_text() == f"keep {n}" and not (tmp_path / "cache/mine.txt").exists()
    assert files.set_aside(spark, f"{tmp_path}/none") is None


def test_target_plan(spark):
    wanted = spark.createDataFrame([("t1", "s1"), ("t2", "s2"), ("t3", "s3"), ("t3", "s4"), ("t5", "s5"), ("t5", "s5")], "target string, source string")
    have = spark.createDataFrame([("t2", "s2"), ("t5", "other"), ("t9", "s9")], "target string, source string")
    assert rows(src.target_plan(wanted, have), "target", "state") == [("t1", "new"), ("t2", "same"), ("t3", "collision"), ("t5", "collision"), ("t9", "extra")]


def test_rows_as_text(spark):
    df = spark.createDataFrame([("b", None, 1.23456), (None, 2, None)], "name string, k int, x double")
    assert [json.loads(r.value) for r in src.rows_as_json(df).collect()] == [{"k": None, "name": "b", "x": 1.23456}, {"k": 2, "name": None, "x": None}]
    assert [r.value for r in src.rows_as_csv(df, ["name", "k"]).collect()] == ["b,", ",2"]
    assert [r.line for r in src.report_rows(df, ["name", "k", "x"]).collect()] == ["| b | - | 1.235 |", "| - | 2 | - |"]
    assert src.markdown([{"a": None, "b": 1.0}], ["a", "b"], 2) == "| a | b |\n|---|---|\n| - | 1.00 |"
    wide = src.matrix(spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "row string, col string, v int"), "row", "col", "v", ["a", "b", "c"]).first()
    assert tuple(wide) == ("r", 1, 2, None)
