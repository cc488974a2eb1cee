"""The exact bounded draws that models learn from, and the scratch folder."""

import weakref

import pytest
from pyspark.sql import functions as F

from quillmere.llm import shared
from quillmere.llm.shared import bounded_ids, bounded_rows, hash_cut, scratch_folder


def test_cut_never_falls_to_nothing():
    low, high = -(1 << 63), (1 << 63) - 1
    assert hash_cut(10, 10) == high and hash_cut(0, 5) == high
    for n in (10**6, 10**11, 10**15):
        share = (hash_cut(n, 3000) - low) / 2**64
        assert abs(share * n - 6000) < 1 and low < hash_cut(n, 3000) < high


def test_all_rows_where_they_are_few(spark):
    df = spark.createDataFrame([(f"t{k % 3}", "a") for k in range(9)], "text string, lang string")
    assert bounded_rows(df, 9, "lang").count() == 9


def test_a_hot_text_and_a_rare_value(spark):
    """16,000 of 20,000 rows are one text, and one language has a single row: the bound is exact and each language stays."""
    hot = spark.range(16_000).select(F.lit("the hot text").alias("text"), F.lit("a").alias("lang"))
    many = spark.range(3_999).select(F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("lang"))
    rare = spark.createDataFrame([("single", "c")], "text string, lang string")
    rows = hot.unionByName(many).unionByName(rare)
    got = bounded_rows(rows, 300, "lang").collect()
    per = {lang: sum(r.lang == lang for r in got) for lang in "abc"}
    assert per == {"a": 100, "b": 100, "c": 1} and len({r.text for r in got}) == 201
    assert sorted(got) == sorted(bounded_rows(rows.repartition(7), 300, "lang").collect())
    assert bounded_rows(rows, 300).count() == 300


def test_ids_are_bounded_with_repeats(spark):
    labels = spark.range(5000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(1).alias("toxic"))
    got = bounded_ids(labels, 200)
    assert got.count() == 200 and sorted(got.collect()) == sorted(bounded_ids(labels.repartition(5), 200).collect())
    assert bounded_ids(labels.where("doc_id = 7"), 50).count() == 50
    assert bounded_ids(labels.limit(0), 50).count() == 0


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        scratch_folder(Session())


def test_discard_deletes_what_was_written(spark):
    import os

    from quillmere.llm.shared import connected_components, discard, materialize

    table = materialize(spark.range(5), "discarded")
    path = table.scratch_path.removeprefix("file://")
    assert os.path.isdir(path) and table.count() == 5
    discard(table, spark.range(3))  # a frame that was never written is left alone
    assert not os.path.exists(path)
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (None, 4)], "a long, b long")
    found = connected_components(edges, name="discard-test")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    folder = os.path.dirname(path)
    assert sum(n.startswith("discard-test") for n in os.listdir(folder)) == 1


def test_memory_is_given_back_when_nothing_is_held(monkeypatch):
    """After a task's last row, and only once what the task remembered is gone."""

    class Cache(dict):
        pass

    caches, gone = [], []

    def run(batches):
        cache = Cache()
        caches.append(weakref.ref(cache))
        for b in batches:
            yield b

    monkeypatch.setattr(shared, "give_back", lambda: gone.append(caches[0]() is None))
    assert list(shared.giving_back(run)(iter([1, 2]))) == [1, 2]
    assert gone == [True]
