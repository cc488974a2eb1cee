"""Operators on DataFrames: ranking and selection, geometry, joins, summaries, audits, clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..tables import written

# ---- ranking and selection -----------------------------------------------------------------------


def average_tie_percentile(value: str, *by: str) -> Column:
    """Mean 0-based rank of the tie block over n - 1 (at least 1)."""
    w = Window.partitionBy(*by)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    rank = F.rank().over(w.orderBy(value)) - 1
    return (rank + (ties - 1) / F.lit(2.0)) / F.greatest(F.count("*").over(w) - 1, F.lit(1))


def ordinal_percentile(value: str, tie: str, *by: str) -> Column:
    w = Window.partitionBy(*by)
    return (F.row_number().over(w.orderBy(value, tie)) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1)).cast("double")


def average_rank(value: str, *by: str) -> Column:
    """1-based rank, ties share their mean."""
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / F.lit(2.0)


def top_per_group(df: DataFrame, k: int, by: str, *order: Column, slot: str = "slot") -> DataFrame:
    """The first ``k`` rows of each group in a total order, with their 0-based slot."""
    ranked = df.withColumn(slot, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    return ranked.where(F.col(slot) < k)


def hash_fold(by: str, seed: int, identity: str, folds: int) -> Column:
    """Round-robin folds in hash order within each group."""
    order = fn.sampling_key(F.lit(seed), F.col(identity))
    return (F.row_number().over(Window.partitionBy(by).orderBy(order, identity)) - 1) % folds


# ---- geometry ------------------------------------------------------------------------------------


def prototypes(unit: DataFrame, label: str = "label", vector: str = "unit") -> DataFrame:
    """Per label the normalised sum of its unit vectors, element by element with map-side combination."""
    parts = unit.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.sum("x").alias("x"))
    lists = parts.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("s"))
    return lists.select(label, fn.normalised(F.transform("s", lambda e: e["x"])).alias("proto"))


#: Prototypes that are held beside each vector, at most; more are joined.
FEW_PROTOTYPES = 4_096


def margins(unit: DataFrame, protos: DataFrame, identity: str = "vec_id", label: str = "label") -> DataFrame:
    """Similarity to the own prototype, to the nearest other one (smallest label of equals), and their difference. Where prototypes are
    few (counted first), each vector looks at all of them in place and nothing is shuffled."""
    kept = F.col("own").alias("own"), (-F.col("r.s")).alias("rival"), F.col("r.l").alias("rival_label"), (F.col("own") + F.col("r.s")).alias("margin")
    if protos.count() <= FEW_PROTOTYPES:
        listed = protos.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), "proto"))).alias("protos"))
        sims = unit.join(F.broadcast(listed)).withColumn("sims", F.transform("protos", lambda p: F.struct((-fn.dot(F.col("unit"), p["proto"])).alias("s"), p["l"].alias("l"))))
        own = -F.filter("sims", lambda x: x["l"] == F.col(label))[0]["s"]
        found = sims.select(identity, label, own.alias("own"), F.array_min(F.filter("sims", lambda x: x["l"] != F.col(label))).alias("r"))
        return found.select(identity, label, *kept)
    other = protos.select(F.col(label).alias("p_label"), "proto")
    sims = unit.join(other).select(identity, label, "p_label", fn.dot(F.col("unit"), F.col("proto")).alias("sim"))
    own = F.max(F.when(F.col("p_label") == F.col(label), F.col("sim"))).alias("own")
    rival = F.min(F.when(F.col("p_label") != F.col(label), F.struct((-F.col("sim")).alias("s"), F.col("p_label").alias("l")))).alias("r")
    return sims.groupBy(identity, label).agg(own, rival).select(identity, label, *kept)


#: Up to so many blocks every tile is looked at.
FEW_BLOCKS = 16


def blocked_neighbours(vectors: DataFrame, k: int, queries: DataFrame | None = None, block: int = 1024, within: str | None = None) -> DataFrame:
    """Exact ``k`` nearest by cosine, self excluded: blocks of queries meet blocks of rows (in the same group if ``within``), each
    tile is one matrix product that leaves ``k`` rows a query, and a rank merges them. ``vectors``: vec_id, unit and ``within``. Of more than
    ``FEW_BLOCKS`` blocks tiles that cannot hold a neighbour are left out (``neighbours.pruned``)."""
    if vectors.count() > FEW_BLOCKS * block:
        from .neighbours import pruned

        return pruned(vectors, k, queries, block, within)
    queries = vectors if queries is None else queries
    group = F.col(within).cast("long") if within else F.lit(0).cast("long")
    # each group has as many blocks as its own rows and queries need
    sizes = lambda d, name: d.groupBy(group.alias("g")).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(name))
    blocks = sizes(vectors, "n").join(sizes(queries, "m"), "g")
    cut = lambda d, c: d.select(group.alias("g"), "vec_id", "unit").join(blocks, "g").withColumn("mine", F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = cut(queries, "m").select("g", F.col("mine").alias("i"), every("n").alias("j"), F.lit(True).alias("asks"), "vec_id", "unit")
    right = cut(vectors, "n").select("g", every("m").alias("i"), F.col("mine").alias("j"), F.lit(False).alias("asks"), "vec_id", "unit")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        q, r = pdf[asks], pdf[~asks]
        if not len(q) or not len(r):
            return pd.DataFrame({"vec_id": [], "neighbour": [], "sim": []})
        ids = r["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        sim = np.vstack(q["unit"].to_numpy()) @ np.vstack(r["unit"].to_numpy()[order]).T
        ids = ids[order]
        sim[q["vec_id"].to_numpy()[:, None] == ids[None]] = -np.inf
        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        at = np.arange(len(q))[:, None]
        out = pd.DataFrame({"vec_id": np.repeat(q["vec_id"].to_numpy(), best.shape[1]), "neighbour": ids[best].ravel(), "sim": sim[at, best].ravel()})
        return out[np.isfinite(out["sim"])]

    near = left.unionByName(right).groupBy("g", "i", "j").applyInPandas(tile, "vec_id long, neighbour long, sim double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc(F.round("sim", 9)), "neighbour"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


# ---- summaries -----------------------------------------------------------------------------------


def sample_stats(value: str, zero_sd: bool = False) -> list[Column]:
    """Count, mean, sample deviation (null, or 0, below two), least and largest."""
    sd = F.stddev_samp(value)
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), (F.coalesce(sd, F.lit(0.0)) if zero_sd else sd).alias("sd"), F.min(value).alias("least"), F.max(value).alias("largest")]


def distribution(value: str, quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> list[Column]:
    return [*sample_stats(value), *(F.percentile(value, q).alias(f"p{round(q * 100):02d}") for q in quantiles)]


def two_level(df: DataFrame, value: str, outer: str, inner: str) -> DataFrame:
    """Grand mean, pooled deviation within levels of ``outer`` (root of the mean variance), deviation of their means."""
    cells = df.groupBy(outer, inner).agg(F.avg(value).alias("cell"))
    levels = cells.groupBy(outer).agg(F.avg("cell").alias("mean"), F.var_samp("cell").alias("var"))
    return levels.agg(F.avg("mean").alias("grand_mean"), F.sqrt(F.avg("var")).alias("sd_within"), F.stddev_samp("mean").alias("sd_between"), F.count("*").alias("levels"))


# ---- joins and audits ----------------------------------------------------------------------------


def missing_keys(expected: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    return expected.select(*keys).distinct().join(observed.select(*keys).distinct(), list(keys), "left_anti")


def bijection_faults(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, or more than once on a side."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.where("n_left <> 1 or n_right <> 1")


#: Rows of a key that one task sorts without harm.
HOT_KEY = 1_000_000


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, forward: bool = False, width: float | None = None) -> DataFrame:
    """For each left row the value of the last right row of its key at or before ``at`` (``forward``: the first one at or after it): one sort
    of the union, no range join. With ``width`` (microseconds for timestamps) the axis is cut into slices that are sorted apart, and what a
    slice carries over from those before it is worked out from one value a slice, so that a frequent key is spread over many tasks; where no key has
    more than ``HOT_KEY`` rows, which an aggregate of the keys alone tells, one sort does."""
    if width:
        rows = left.select(key).unionByName(right.select(key)).groupBy(key).count()
        width = width if (rows.agg(F.max("count")).first()[0] or 0) > HOT_KEY else None
    both = left.select(key, at, F.lit(1).alias("asks"), F.struct(*left.columns).alias("row"), F.lit(None).alias("v")).unionByName(right.select(key, at, F.lit(0).alias("asks"), F.lit(None).alias("row"), F.col(value).alias("v")))
    kind = left.schema[at].dataType.simpleString()
    number = F.unix_micros(F.col(at).cast("timestamp")) if kind.startswith("timestamp") else F.col(at)
    both = both.withColumn("slice", F.floor(number / width) if width else F.lit(0).cast("long"))
    order = F.desc(at) if forward else F.asc(at)
    w = Window.partitionBy(key, "slice").orderBy(order, "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("found", F.last("v", ignorenulls=True).over(w)).where("asks = 1")
    if width:
        nearest = (F.min_by if forward else F.max_by)("v", at).alias("end")
        ends = both.where("asks = 0 and v is not null").groupBy(key, "slice").agg(nearest)
        slices = both.groupBy(key, "slice").agg(F.lit(1).alias("one")).join(ends.withColumnsRenamed({key: "e_key", "slice": "e_slice"}), F.col(key).eqNullSafe(F.col("e_key")) & F.col("slice").eqNullSafe(F.col("e_slice")), "left")
        before = Window.partitionBy(key).orderBy(F.desc("slice") if forward else F.asc("slice")).rowsBetween(Window.unboundedPreceding, -1)
        carried = slices.select(F.col(key).alias("c_key"), F.col("slice").alias("c_slice"), F.last("end", ignorenulls=True).over(before).alias("carried"))
        found = found.join(carried, F.col(key).eqNullSafe(F.col("c_key")) & F.col("slice").eqNullSafe(F.col("c_slice")), "left").withColumn("found", F.coalesce("found", "carried"))
    return found.select("row.*", F.col("found").alias(value))


def tree_digest(df: DataFrame, by: str, identity: str, content: str, per: int = 100_000) -> DataFrame:
    """``by, digest``: a digest over the digests of ranges of ``per`` ids, each over the lines ``id:sha256`` in order of id. What is gathered is a
    range's lines, then one digest a range, so no group is collected row by row."""
    lines = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda s: s["line"]), "\n")
    line = F.concat(F.col(identity).cast("string"), F.lit(":"), F.sha2(content, 256))
    rows = df.where(F.col(content).isNotNull()).select(by, F.floor(F.col(identity) / per).alias("part"), F.struct(F.col(identity).alias("k"), line.alias("line")).alias("x"))
    parts = rows.groupBy(by, "part").agg(F.sha2(lines("x"), 256).alias("line"))
    return parts.groupBy(by).agg(F.sha2(lines(F.struct("part", "line")), 256).alias("digest"))


def hamming_pairs(df: DataFrame, identity: str, code: str, most: int) -> DataFrame:
    """Pairs of rows whose 64-bit codes differ in at most ``most`` bits: cut into ``most + 1`` bands, one must agree (pigeonhole),
    so an equi-join finds all. Equal codes meet once, as one class with its smallest id."""
    n = most + 1
    edges = [64 * k // n for k in range(n + 1)]
    classes = df.groupBy(code).agg(F.min(identity).alias(identity))
    bands = F.array(*(F.shiftrightunsigned(F.shiftleft(F.col(code), 64 - edges[k + 1]), 64 - edges[k + 1] + edges[k]) for k in range(n)))
    cut = classes.select(identity, code, F.posexplode(bands).alias("band", "bits"))
    other = cut.select(F.col(identity).alias("other"), F.col(code).alias("c2"), F.col("band").alias("b2"), F.col("bits").alias("t2"))
    near = cut.join(other, (F.col("band") == F.col("b2")) & (F.col("bits") == F.col("t2")) & (F.col(identity) < F.col("other")))
    return near.withColumn("bits_apart", F.bit_count(F.col(code).bitwiseXOR(F.col("c2")))).where(F.col("bits_apart") <= most).select(identity, "other", "bits_apart").distinct()


def problems(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row for each failed check: its name, how many rows fail it, and how many there are. All in one pass."""
    counted = df.agg(F.count("*").alias("rows"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("problem"), F.col(name).alias("failed")) for name in checks))
    return counted.select("rows", F.explode(pairs).alias("p")).where("p.failed > 0").select("p.problem", "p.failed", "rows")


# ---- clustering (per group, iterative) -----------------------------------------------------------


def _kmeans(x: np.ndarray, k: int, seed: int, iterations: int = 30, restarts: int = 4) -> np.ndarray:
    best, top = None, -np.inf
    for r in range(restarts):
        rng = np.random.default_rng([seed, r])
        c = x[rng.permutation(len(x))[:k]]
        for _ in range(iterations):
            s = x @ c.T
            own = s.argmax(axis=1)
            new = np.stack([x[own == j].sum(axis=0) if (own == j).any() else x[s.max(axis=1).argmin()] for j in range(len(c))])
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
            if np.allclose(new, c):
                break
            c = new
        score = (x @ c.T).max(axis=1).mean()
        if score > top:
            best, top = (x @ c.T).argmax(axis=1), score
    return best


def spherical_kmeans(vectors: DataFrame, k: int, seed: int = 0, most: int = 20_000, rounds: int = 20) -> DataFrame:
    """Clusters within each label: ``vec_id, label, cluster``. The restarts that find where to begin see at most ``most`` vectors of a label (those
    with the smallest hash); from there Lloyd's steps run over all vectors, as aggregates, until none changes its cluster or ``rounds`` are
    done. Each step brings the driver the centres alone: ``k`` a label."""
    w = Window.partitionBy("label").orderBy(F.xxhash64("vec_id"), "vec_id")
    vectors = vectors.where("label is not null")
    sample = vectors.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x = np.vstack(pdf["unit"].to_numpy())
        own = _kmeans(x, min(k, len(x)), seed)
        c = [x[own == j].sum(axis=0) for j in np.unique(own)]
        return pd.DataFrame({"label": pdf["label"].iloc[0], "centres": [[(v / max(np.linalg.norm(v), 1e-12)).tolist() for v in c]]})

    found = sample.select("label", "vec_id", "unit").groupBy("label").applyInPandas(begin, "label int, centres array<array<double>>").collect()
    centres = {r.label: np.array(r.centres) for r in found}

    def assigned(now: dict[int, np.ndarray]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                own = np.zeros(len(pdf), int)
                labels = pdf["label"].to_numpy()
                for label in np.unique(labels):
                    at = np.flatnonzero(labels == label)
                    own[at] = (np.vstack(pdf["unit"].to_numpy()[at]) @ now[int(label)].T).argmax(axis=1)
                yield pdf[["vec_id", "label"]].assign(cluster=own.astype("int32"))

        return vectors.select("vec_id", "label", "unit").mapInPandas(run, "vec_id long, label int, cluster int")

    def sums(now: dict[int, np.ndarray]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {label: np.zeros_like(c) for label, c in now.items()}  # a task's sums, whatever its rows
            for pdf in batches:
                labels = pdf["label"].to_numpy()
                for label in np.unique(labels):
                    x = np.vstack(pdf["unit"].to_numpy()[labels == label])
                    np.add.at(total[int(label)], (x @ now[int(label)].T).argmax(axis=1), x)
            rows = [(label, j, i, float(v)) for label, c in total.items() for j, centre in enumerate(c) for i, v in enumerate(centre) if v]
            yield pd.DataFrame(rows, columns=["label", "cluster", "i", "v"])

        parts = vectors.select("label", "unit").mapInPandas(run, "label int, cluster int, i int, v double")
        return parts.groupBy("label", "cluster", "i").agg(F.sum("v").alias("v")).collect()

    for _ in range(rounds if centres else 0):
        new = {label: np.zeros_like(c) for label, c in centres.items()}
        for r in sums(centres):
            new[r.label][r.cluster, r.i] = r.v
        for label, c in new.items():
            size = np.linalg.norm(c, axis=1, keepdims=True)
            new[label] = np.where(size > 1e-12, c / np.maximum(size, 1e-12), centres[label])  # an empty cluster keeps its centre
        moved = max(float(np.abs(new[label] - centres[label]).max()) for label in centres)
        centres = new
        if moved < 1e-9:
            break
    return assigned(centres)


def _facility_gains(vectors: DataFrame, block: int):
    """Sizes of the labels of ``vectors`` (``label``, ``vec_id``, ``unit``), and a function of the vectors held so far (by label) that gives ``label,
    vec_id, gain``: each candidate's sum, over all vectors of its label, of the similarity to the nearest held or to itself. Blocks of a label
    meet in tiles of bounded memory."""
    sizes = {r.label: r.n for r in vectors.groupBy("label").agg(F.count("*").alias("n")).collect()}
    blocks = F.create_map(*(F.lit(x) for label, n in sizes.items() for x in (label, -(-n // block))))[F.col("label")] if sizes else F.lit(1)
    cut = vectors.withColumn("mine", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    both = cut.select("label", F.col("mine").alias("i"), other, F.lit(True).alias("asks"), "vec_id", "unit").withColumnRenamed("other", "j")
    both = both.unionByName(cut.select("label", other, F.col("mine").alias("j"), F.lit(False).alias("asks"), "vec_id", "unit").withColumnRenamed("other", "i"))

    def gains(held: dict[int, np.ndarray]) -> DataFrame:
        def tile(pdf: pd.DataFrame) -> pd.DataFrame:
            asks = pdf["asks"].to_numpy()
            rows, able = pdf[asks], pdf[~asks]
            if not len(rows) or not len(able):
                return pd.DataFrame({"label": [], "vec_id": [], "gain": []})
            x, c = np.vstack(rows["unit"].to_numpy()), np.vstack(able["unit"].to_numpy())
            own = held.get(int(pdf["label"].iloc[0]))
            near = (x @ own.T).max(axis=1) if own is not None and len(own) else np.full(len(x), -1.0)
            return pd.DataFrame({"label": able["label"].to_numpy(), "vec_id": able["vec_id"].to_numpy(), "gain": np.maximum(near[:, None], x @ c.T).sum(axis=0)})

        tiles = both.groupBy("label", "i", "j").applyInPandas(tile, "label int, vec_id long, gain double")
        return tiles.groupBy("label", "vec_id").agg(F.sum("gain").alias("gain"))

    return sizes, gains


def _facility_sums(vectors: DataFrame, held: dict[int, np.ndarray], asked: dict[int, list[tuple[int, np.ndarray]]]) -> dict[int, dict[int, float]]:
    """For each label and candidate asked for the sum of the similarities to the nearest held or to itself: one pass, no tiles; a task leaves one sum a
    candidate."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for label, rows in pdf[pdf["label"].isin(asked.keys())].groupby("label"):
                x, c = np.vstack(rows["unit"]), np.stack([u for _, u in asked[label]])
                near = (x @ held[label].T).max(axis=1)
                total[label] = total.get(label, 0.0) + np.maximum(near[:, None], x @ c.T).sum(axis=0)
        yield pd.DataFrame([(label, v, float(t)) for label, sums_ in total.items() for (v, _), t in zip(asked[label], sums_)], columns=["label", "vec_id", "gain"])

    told = vectors.select("label", "unit").mapInPandas(sums, "label int, vec_id long, gain double").groupBy("label", "vec_id").agg(F.sum("gain").alias("gain"))
    out: dict[int, dict[int, float]] = {}
    for r in told.collect():
        out.setdefault(r.label, {})[r.vec_id] = r.gain
    return out


#: Candidates of a label that are tried at first where their bounds are known, and at most before all are looked at again.
TRIED, MOST_TRIED = 32, 4_096


def greedy_facility(vectors: DataFrame, k: int, block: int = 2_048) -> DataFrame:
    """Per label ``k`` vectors that greedily raise the mean similarity of each vector to its nearest chosen one: ``label, slot, vec_id, utility``.

    All vectors of a label are candidates and all count; the best candidate (smallest id of equals) takes each slot. The first two slots look
    at all pairs, in tiles. What a candidate adds can only fall from slot to slot, so from then on candidates are tried in order of what
    they added last, until no other can do better: a pass over the vectors for each few candidates. The driver holds the chosen and those tried."""
    vectors = written(vectors.where("label is not null").select("label", "vec_id", "unit"), "facility-vectors")
    sizes, gains = _facility_gains(vectors, block)
    chosen: dict[int, list] = {label: [] for label in sizes}
    bounds, fresh = None, {}

    def whole(labels: list[int], slot: int) -> None:
        """The slot's best of all candidates of the labels, and everybody's bound for the next."""
        nonlocal bounds
        taken = [v for own in chosen.values() for _, v, _, _ in own]
        summed = gains({label: np.array([u for *_, u in own]) for label, own in chosen.items() if own})
        summed = written(summed.where(F.col("label").isin(labels) & ~F.col("vec_id").isin(taken)), "facility-gains")
        mean = F.col("gain") / F.create_map(*(F.lit(x) for label, n in sizes.items() for x in (label, n)))[F.col("label")]
        best = summed.groupBy("label").agg(F.min(F.struct(F.round(-mean, 12).alias("u"), "vec_id")).alias("b")).select("label", "b.vec_id", (-F.col("b.u")).alias("utility"))
        before = {label: chosen[label][-1][2] * n if chosen[label] else -float(n) for label, n in sizes.items()}
        now = summed.select("label", "vec_id", (F.col("gain") - F.create_map(*(F.lit(x) for label, f in before.items() for x in (label, f)))[F.col("label")]).alias("bound"))
        bounds = now if bounds is None else bounds.where(~F.col("label").isin(labels)).unionByName(now)
        for label in labels:
            fresh[label] = {}
        for r in best.join(vectors, ["label", "vec_id"]).collect():
            chosen[r.label].append((slot, r.vec_id, r.utility, np.array(r.unit)))

    for slot in range(min(k, max(sizes.values(), default=0))):
        open_ = [label for label, n in sizes.items() if n > slot]
        if slot < 2:
            whole(open_, slot)
            continue
        tries, known = dict.fromkeys(open_, TRIED), {label: {} for label in open_}
        while tries:
            deep = [label for label, t in tries.items() if t > MOST_TRIED]
            if deep:
                whole(deep, slot)
                for label in deep:
                    del tries[label]
                continue
            # the highest bounds of each label, with those that have been tried since at what they added then
            wanted = {label: t + len(fresh[label]) + slot + 1 for label, t in tries.items()}
            rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("bound"), "vec_id"))
            most = F.create_map(*(F.lit(x) for label, n in wanted.items() for x in (label, n)))[F.col("label")]
            top: dict[int, list] = {label: [] for label in tries}
            for r in bounds.where(F.col("label").isin(list(tries))).withColumn("at", rank).where(F.col("at") <= most).join(vectors, ["label", "vec_id"]).collect():
                top[r.label].append((fresh[r.label].get(r.vec_id, r.bound), r.vec_id, np.array(r.unit)))
            asked, rest = {}, {}
            for label, rows in top.items():
                taken = {v for _, v, _, _ in chosen[label]}
                rows = sorted((x for x in rows if x[1] not in taken), key=lambda x: (-x[0], x[1]))
                first = rows[: tries[label]]
                rest[label] = rows[tries[label]][0] if len(rows) > tries[label] else -np.inf
                asked[label] = [(v, u) for _, v, u in first if v not in known[label]]
            found = _facility_sums(vectors, {label: np.stack([u for *_, u in chosen[label]]) for label in asked}, {label: a for label, a in asked.items() if a})
            for label in list(tries):
                units = {v: u for _, v, u in top[label]}
                before = chosen[label][-1][2] * sizes[label]
                for v, total in found.get(label, {}).items():
                    known[label][v] = (total, units[v])
                    fresh[label][v] = total - before
                best = min(((round(-total / sizes[label], 12), v) for v, (total, _) in known[label].items()), default=None)
                if best and -best[0] > (before + rest[label]) / sizes[label] + 1e-9:
                    chosen[label].append((slot, best[1], -best[0], known[label][best[1]][1]))
                    del tries[label]
                elif best is None and rest[label] == -np.inf:
                    del tries[label]
                else:
                    tries[label] *= 4
    rows = [(label, s, int(v), float(u)) for label, own in chosen.items() for s, v, u, _ in own]
    return vectors.sparkSession.createDataFrame(rows, "label int, slot int, vec_id long, utility double")


def joint_facility(vectors: DataFrame, source: str, block: int = 2_048, rounds: int = 10) -> DataFrame:
    """Per label one vector of each ``source`` (an integer column), chosen together: ``label, source, vec_id, utility``.

    Greedily, the candidate of any open source that raises the utility most is taken (of equals the smallest source, then id) and closes its source; then each
    source in turn may exchange its vector for one that does better beside the others, until none does or ``rounds`` are over."""
    vectors = vectors.where("label is not null").select("label", "vec_id", "unit", F.col(source).cast("int").alias("source")).where("source is not null")
    sizes, gains = _facility_gains(vectors.select("label", "vec_id", "unit"), block)
    sources = {r.label: sorted(r.s) for r in vectors.groupBy("label").agg(F.collect_set("source").alias("s")).collect()}
    chosen: dict[int, dict[int, tuple]] = {label: {} for label in sizes}

    def best_of(held: dict[int, np.ndarray], able: list[tuple[int, int]]) -> list:
        """The best candidate of each label among its able sources."""
        asked = vectors.sparkSession.createDataFrame(able, "label int, source int")
        mean = F.col("gain") / F.create_map(*(F.lit(x) for label, n in sizes.items() for x in (label, n)))[F.col("label")]
        rows = gains(held).join(vectors.join(F.broadcast(asked), ["label", "source"]), ["label", "vec_id"])
        return rows.groupBy("label").agg(F.min(F.struct(F.round(-mean, 12).alias("u"), "source", "vec_id", "unit")).alias("b")).select("label", "b.*").collect()

    others = lambda label, out=None: np.array([v[2] for s, v in chosen[label].items() if s != out])
    for _ in range(max(map(len, sources.values()), default=0)):
        able = [(label, s) for label, of in sources.items() for s in of if s not in chosen[label]]
        for r in best_of({label: others(label) for label in sizes}, able):
            chosen[r.label][r.source] = (r.vec_id, -r.u, r.unit)
    for _ in range(rounds):
        changed = False
        for place in range(max(map(len, sources.values()), default=0)):
            turn = {label: of[place] for label, of in sources.items() if place < len(of)}
            for r in best_of({label: others(label, s) for label, s in turn.items()}, list(turn.items())):
                old = chosen[r.label][r.source]
                utility = max(u for _, u, _ in chosen[r.label].values())
                if r.vec_id != old[0] and -r.u > utility + 1e-12:
                    changed = True
                    chosen[r.label][r.source] = (r.vec_id, -r.u, r.unit)
        if not changed:
            break
    rows = [(label, s, v, max(u for _, u, _ in own.values())) for label, own in chosen.items() for s, (v, _, _) in own.items()]
    return vectors.sparkSession.createDataFrame(rows, "label int, source int, vec_id long, utility double")


def two_means(vectors: DataFrame, seed: int, inits: int = 4, rounds: int = 30) -> DataFrame:
    """Two clusters a label, each by its nearest real vector: ``label, cluster, vec_id, sim, size, init``, clusters numbered by that vector's id.

    Each start draws its first vector by a hash of seed, label, start and id, and its second with chances in proportion to the distance from it (a race of
    exponentials keyed by identity, so that no order of rows matters). Lloyd's steps of all starts run together over all vectors, as
    aggregates; of the starts the one with the least inertia wins, then the smaller ids, then the earlier start. A cluster that loses all
    its vectors keeps its centre. The driver holds centres alone: ``2 * inits`` a label."""
    v = vectors.where("label is not null").select("label", "vec_id", "unit")
    each = v.withColumn("init", F.explode(F.sequence(F.lit(0), F.lit(inits - 1))))
    key = lambda part: fn.sampling_key(F.lit(seed), F.col("label"), F.col("init"), F.lit(part), F.col("vec_id"))
    first = each.groupBy("label", "init").agg(F.min(F.struct(key("first").alias("h"), "vec_id", "unit")).alias("a")).select("label", "init", F.col("a.vec_id").alias("f_id"), F.col("a.unit").alias("f_unit"))
    far = F.greatest(1 - fn.dot(F.col("unit"), F.col("f_unit")), F.lit(0.0))
    u = (fn.identity_seed(F.lit(seed), F.col("label"), F.col("init"), F.lit("second"), F.col("vec_id")).cast("double") + 0.5) / F.lit(float(2**63))
    race = F.when(far > 1e-12, -F.log(u) / far).otherwise(F.lit(float("inf")))  # nothing apart: the smallest other id
    pair = each.join(F.broadcast(first), ["label", "init"]).where("vec_id <> f_id").groupBy("label", "init").agg(F.min(F.struct(race.alias("t"), "vec_id", "unit")).alias("b"))
    pair = first.join(pair, ["label", "init"], "left").select("label", "init", "f_unit", F.col("b.unit").alias("s_unit")).collect()
    centres = {(r.label, r.init): np.array([r.f_unit, r.s_unit or r.f_unit]) for r in pair}

    def pass_over(now: dict, ids: bool) -> DataFrame:
        """Sums of each cluster (``i`` >= 0), its size and inertia (``i`` -1 and -2) or, with ``ids``, its nearest vector of each task."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {k: np.zeros((2, c.shape[1] + 2)) for k, c in now.items()}
            near: dict = {}
            for pdf in batches:
                labels = pdf["label"].to_numpy()
                for label in np.unique(labels):
                    x, names = np.vstack(pdf["unit"].to_numpy()[labels == label]), pdf["vec_id"].to_numpy()[labels == label]
                    for init in range(inits):
                        sim = x @ now[int(label), init].T
                        own = sim.argmax(axis=1)
                        np.add.at(total[int(label), init], own, np.hstack([x, np.ones((len(x), 1)), 1 - sim.max(axis=1)[:, None]]))
                        for j in np.unique(own).tolist() if ids else ():
                            at = np.flatnonzero(own == j)
                            best = min(zip((-np.round(sim[at, j], 12)).tolist(), names[at].tolist(), strict=True))
                            near[int(label), init, j] = min(best, near.get((int(label), init, j), best))
            if ids:
                rows = [(label, init, j, name, -s) for (label, init, j), (s, name) in near.items()]
            else:
                rows = [(label, init, j, i if i < t.shape[1] - 2 else t.shape[1] - 3 - i, float(x)) for (label, init), t in total.items() for j in (0, 1) for i, x in enumerate(t[j])]
            yield pd.DataFrame(rows, columns=["label", "init", "cluster", "i", "v"])

        parts = v.select("label", "vec_id", "unit").mapInPandas(run, "label int, init int, cluster int, i long, v double")
        if ids:
            return parts.groupBy("label", "init", "cluster").agg(F.min(F.struct((-F.col("v")).alias("s"), "i")).alias("b")).select("label", "init", "cluster", F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("sim"))
        return parts.groupBy("label", "init", "cluster", "i").agg(F.sum("v").alias("v"))

    sizes: dict = {}
    for _ in range(rounds if centres else 0):
        new, inertia = {k: np.zeros_like(c) for k, c in centres.items()}, {k: 0.0 for k in centres}
        for r in pass_over(centres, False).collect():
            if r.i >= 0:
                new[r.label, r.init][r.cluster, r.i] = r.v
            elif r.i == -1:
                sizes[r.label, r.init, r.cluster] = int(r.v)
            else:
                inertia[r.label, r.init] += r.v
        for k, c in new.items():
            length = np.linalg.norm(c, axis=1, keepdims=True)
            new[k] = np.where(length > 1e-12, c / np.maximum(length, 1e-12), centres[k])
        moved = max(float(np.abs(new[k] - centres[k]).max()) for k in centres)
        if moved < 1e-9:
            break
        centres = new
    if not centres:
        return v.select("label", F.lit(0).alias("cluster"), "vec_id", F.lit(0.0).alias("sim"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("init"))
    found: dict = {}
    for r in pass_over(centres, True).collect():
        found.setdefault((r.label, r.init), []).append((r.vec_id, r.sim, sizes[r.label, r.init, r.cluster]))
    rows = []
    for label in sorted({k[0] for k in found}):
        best = min((k for k in found if k[0] == label), key=lambda k: (round(inertia[k], 9), sorted(x[0] for x in found[k]), k[1]))
        rows += [(label, place, name, sim, n, best[1]) for place, (name, sim, n) in enumerate(sorted(found[best]))]
    return v.sparkSession.createDataFrame(rows, "label int, cluster int, vec_id long, sim double, size long, init int")


from .experiments import block_adjusted, caliper_pairs, class_gradients, gradient_alignment, hamming_exists, hamming_links, interleaved, most_disorder, provenance_faults, rebuilt, two_way_components  # noqa: E402

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Iterator", "np", "pd", "Column", "DataFrame", "Window", "F", "annotations")]
