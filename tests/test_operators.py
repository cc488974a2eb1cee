"""Golden values and invariants of the library's functions and operators."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quillmere import functions as fn
from quillmere import operators as op


@pytest.mark.parametrize("values, want", [([1, 2, 3], [0, 0.5, 1]), ([1, 1, 2], [0.25, 0.25, 1]), ([1, 2, 2], [0, 0.75, 0.75]), ([5], [0])])
def test_average_tie_percentile(spark, values, want):
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(values)], "g int, k int, v int")
    assert [r.p for r in df.select("k", op.average_tie_percentile("v", "g").alias("p")).orderBy("k").collect()] == want


def test_identity_seed_and_gumbel(spark):
    df = spark.createDataFrame([(k,) for k in range(50)], "k int")
    for row in df.select("k", fn.identity_seed(F.lit(7), F.col("k")).alias("s"), fn.gumbel(F.lit(7), F.col("k")).alias("g"), fn.gumbel(F.lit(8), F.col("k")).alias("h")).collect():
        want = int.from_bytes(hashlib.sha256(f"7\0{row.k}".encode()).digest()[:8], "little") & (2**63 - 1)
        assert row.s == want and abs(row.g + math.log(-math.log((want + 0.5) / 2**63))) < 1e-9 and row.g != row.h


def test_boxes(spark):
    box = lambda *x: [F.lit(float(v)) for v in x]
    row = spark.range(1).select(fn.box_iou(box(0, 0, 10, 10), box(0, 0, 10, 10)).alias("a"), fn.box_iou(box(0, 0, 10, 10), box(5, 0, 15, 10)).alias("b"), fn.box_iou(box(0, 0, 0, 0), box(1, 1, 1, 1)).alias("c")).first()
    assert row.a == 1 and abs(row.b - 1 / 3) < 1e-12 and row.c == 0


def test_soft_label_order_and_mass(spark):
    p = [0.35, 0.03, 0.01, 0.20, 0.08, 0.06, 0.04, 0.02, 0.11, 0.10]
    df = spark.createDataFrame([(p, 0)], "p array<double>, t int")
    row = df.select(fn.order_of_others(F.col("p"), F.col("t")).alias("o"), fn.keep_top(F.col("p"), 3).alias("k"), fn.keep_top(F.col("p"), 10).alias("all"), fn.entropy(F.col("p")).alias("h"), fn.softmax(F.transform("p", lambda x: F.log(x))).alias("s")).first()
    assert [p[i] for i in row.o] == sorted(p[1:], reverse=True)
    assert abs(sum(row.k) - 1) < 1e-12 and row.k[0] == p[0] and row["all"] == p
    assert abs(row.h + sum(x * math.log(x) for x in p)) < 1e-12 and all(abs(a - b) < 1e-12 for a, b in zip(row.s, p))


def test_as_of_and_bijection(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 10, 1)], "k string, t int, v int")
    assert sorted((r.k, r.t, r.v) for r in op.as_of(left, right, "k", "t", "v").collect()) == [("a", 1, None), ("a", 5, 50), ("b", 9, None)]
    assert sorted(r.k for r in op.bijection_faults(left, right, "k").collect()) == ["a"]


def test_hamming_bands_lose_nothing(spark):
    rng = random.Random(1)
    codes = [rng.getrandbits(63) for _ in range(60)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(6))) for c in codes[:40]]
    got = {(r.id, r.other) for r in op.hamming_pairs(spark.createDataFrame(list(enumerate(codes)), "id long, code long"), "id", "code", 3).collect()}
    first = {}
    for k, c in enumerate(codes):
        first.setdefault(c, k)
    ids = sorted(first.values())
    assert got == {(a, b) for a in ids for b in ids if a < b and bin(codes[a] ^ codes[b]).count("1") <= 3}


def test_selection_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(90)], "vec_id long, label int")
    pick = lambda d: sorted((r.label, r.slot, r.vec_id) for r in op.top_per_group(d, 4, "label", fn.sampling_key(F.lit(1), F.col("vec_id"))).collect())
    assert pick(df.repartition(1)) == pick(df.repartition(7, "vec_id"))
    folds = df.select("label", op.hash_fold("label", 2, "vec_id", 5).alias("f")).groupBy("label", "f").count().collect()
    assert {r["count"] for r in folds} == {6} and len(folds) == 15


def test_clusters_and_facility(spark):
    rows = [(k, k % 3, [math.cos((k // 3 - 9.5) * 0.02), math.sin((k // 3 - 9.5) * 0.02), float(k % 2) * 0.01]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, e array<double>").select("vec_id", "label", fn.normalised(F.col("e")).alias("unit"))
    clusters = op.spherical_kmeans(df, 4).collect()
    assert len(clusters) == 60 and all(len({r.cluster for r in clusters if r.label == g}) == 4 for g in range(3))
    chosen = op.greedy_facility(df, 3).collect()
    for g in range(3):
        own = sorted((r.slot, r.utility) for r in chosen if r.label == g)
        assert len(own) == 3 and own[0][1] <= own[1][1] <= own[2][1]
        vs = [r.unit for r in df.where(F.col("label") == g).collect()]
        best = max(sum(sum(a * b for a, b in zip(x, y)) for x in vs) / len(vs) for y in vs)
        assert abs(own[0][1] - best) < 1e-9


def test_problems_in_one_pass(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "v int")
    assert [(r.problem, r.failed, r.rows) for r in op.problems(df, {"small": F.col("v") < 3, "fine": F.lit(True)}).collect()] == [("small", 2, 3)]
