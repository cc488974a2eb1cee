"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Within a label, vectors are dealt into blocks of bounded size, and each pair of blocks is a tile. A tile is
multiplied in int8-quantised form; each vector's own quantisation error bounds how far the product can be
from the true cosine, and only pairs that may reach the threshold are computed again in double precision.
A tile gives each vector's number of links and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialize, read_table

#: Vectors in a block: a tile's product then takes some 16 MB, however large a label is.
BLOCK = 2048


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x`` (unit vectors, double) as int8 values times a scale; with the norm of what is lost and of what is kept."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    kept = q * scale[:, None]
    # norms are rounded up a little, so that the bound below also covers floating-point error
    return q.astype(np.int8), scale, np.linalg.norm(x - kept, axis=1) * (1 + 1e-12) + 1e-15, np.linalg.norm(kept, axis=1) * (1 + 1e-12)


def possible(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Pairs whose cosine may reach the threshold: ``<x,y> = <x',y'> + <x',dy> + <dx,y'> + <dx,dy>`` and
    each of the last three is at most the product of its norms. Products of int8 values of up to 2^10
    dimensions are exact in float32; longer vectors are multiplied in double."""
    exact = np.float32 if a[0].shape[1] * 127 * 127 < 2**24 else np.float64
    near = (a[0].astype(exact) @ b[0].astype(exact).T).astype(np.float64) * a[1][:, None] * b[1][None]
    # (|x'|+|dx|)(|y'|+|dy|) - |x'||y'| is the sum of the three
    slack = np.outer(a[3] + a[2], b[3] + b[2]) - np.outer(a[3], b[3])
    return near + slack + 1e-12 >= threshold


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with cosine at or above the threshold, in double precision."""
    rows, cols = np.nonzero(possible(quantise(x), quantise(y), threshold))
    keep = np.zeros(len(rows), bool)
    for k in range(0, len(rows), 1 << 16):
        s = slice(k, k + (1 << 16))
        keep[s] = np.einsum("ij,ij->i", x[rows[s]], y[cols[s]]) >= threshold
    return rows[keep], cols[keep]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches over the links ``a``-``b``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        root = new[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``embedding``, ``label``): ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Only vectors of equal, non-null labels and equal length are compared. A vector that is null, empty, zero or has a null
    or non-finite component links with nothing and is its own component. Equal vectors (and repeated rows) are compared once and count as
    so many links; ``n_links`` counts other rows. Rows that share an id but not the vector are judged each by its own vector. A null id is compared under no name: its row has a null component.
    """
    e = F.col("embedding")
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & e.isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", "label", F.transform(e, lambda v: v.cast("double") + 0.0).alias("embedding"), F.coalesce(ok, F.lit(False)).alias("ok"))
    good = rows.where("ok")
    # an id may repeat with another vector, so classes have numbers of their own
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("low_id"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("label").agg(F.count("*").alias("n")).select(F.col("label").alias("of"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = classes.join(sizes, F.col("label") == F.col("of")).drop("of").withColumn("mine", F.pmod(F.xxhash64("rep", "label"), F.col("blocks").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = dealt.select("label", "rep", "copies", "embedding", "mine", other.alias("other")).select("label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "copies", "embedding")

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        mine = table.column("mine").to_numpy()
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        lists = table.column("embedding").combine_chunks()
        flat, offsets = lists.flatten().to_numpy(), np.asarray(lists.offsets)
        offsets = offsets - offsets[0]
        lengths = np.diff(offsets)
        links, low = np.zeros(len(rep), np.int64), rep.copy()
        for size in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == size)
            x = flat[offsets[at][:, None] + np.arange(size)[None]]
            with np.errstate(over="ignore", under="ignore"):
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            left = np.flatnonzero(mine[at] == i)
            right = left if i == j else np.flatnonzero(mine[at] == j)
            a, b = linked_pairs(x[left], x[right], threshold)
            if i == j:
                a, b = a[a < b], b[a < b]
            a, b = left[a], right[b]
            np.add.at(links, at[a], copies[at[b]])
            np.add.at(links, at[b], copies[at[a]])
            order = np.argsort(rep[at], kind="stable")  # places in order of number, so a root is the smallest
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            low[at] = rep[at][order][forest(len(at), place[a], place[b])][place]
        some = links > 0
        return pa.table({"rep": rep[some], "links": links[some], "low": low[some]})

    found = materialize(tiles.groupBy("label", "i", "j").applyInArrow(tile, "rep long, links long, low long"), "vector-links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("low < rep").select(F.col("rep").alias("a"), F.col("low").alias("b")), name="vector-components")
    lows = parts.join(classes.select(F.col("rep").alias("id"), "low_id"), "id").groupBy("component").agg(F.min("low_id").alias("component_id"))
    parts = parts.join(lows, "component").select("id", "component_id")
    named = classes.join(linked.withColumnRenamed("rep", "r1"), F.col("rep") == F.col("r1"), "left").join(parts, F.col("rep") == F.col("id"), "left")
    named = named.select(F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "low_id").alias("component_id"))
    # each row finds its class by its label and vector; a vector's hash comes first, so that the join's key is short
    named = materialize(named.withColumn("c_hash", F.xxhash64("c_label", "c_embedding")), "vector-named")
    done = rows.withColumn("hash", F.xxhash64("label", "embedding")).join(named, (F.col("hash") == F.col("c_hash")) & (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding")) & F.col("ok"), "left")
    component = F.coalesce("component_id", "vec_id")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))
