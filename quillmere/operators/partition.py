"""Balanced assignment, representatives, box suppression and matching within batches."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..tables import numbered, written
from . import prototypes


def capacities(sim: np.ndarray) -> np.ndarray:
    """Places of each column in a matrix of similarities."""
    return _places(np.bincount(sim.argmax(axis=1), minlength=sim.shape[1]))


def balance(sim: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """The assignment of rows to columns with the greatest total similarity in which sizes differ by at most one. Rows start at
    their best column; the surplus then leaves along cheapest chains of moves (successive shortest paths over the columns and a
    pool that holds the ``n mod k`` places above the floor), which keeps each step optimal. With ``places`` each column has just so many."""
    n, k = sim.shape
    own = sim.argmax(axis=1)
    floor, extra = divmod(n, k)
    surplus = np.append(np.bincount(own, minlength=k) - (floor if places is None else places), -extra if places is None else 0)
    above = np.zeros(k, dtype=bool)  # columns that use a place of the pool
    while (surplus > 0).any():
        cost, mover = np.full((k + 1, k + 1), np.inf), np.full((k + 1, k + 1), -1)
        for a in range(k):
            rows = np.flatnonzero(own == a)
            if len(rows):
                loss = sim[rows, a][:, None] - sim[rows]
                first = loss.argmin(axis=0)
                cost[a, :k], mover[a, :k] = loss[first, np.arange(k)], rows[first]
            if places is None:
                cost[k if above[a] else a, a if above[a] else k] = 0.0
        np.fill_diagonal(cost, np.inf)
        dist, back = np.where(surplus > 0, 0.0, np.inf), np.full(k + 1, -1)
        for _ in range(k + 1):
            through = dist[:, None] + cost
            better = through.min(axis=0) < dist - 1e-12
            if not better.any():
                break
            back[better] = through.argmin(axis=0)[better]
            dist = np.minimum(dist, np.where(better, through.min(axis=0), dist))
        end = at = int(np.where(surplus < 0, dist, np.inf).argmin())
        while back[at] >= 0 and not (surplus[at] > 0 and dist[at] == 0.0):
            a, at = int(back[at]), at
            if at == k:
                above[a] = True
            elif a == k:
                above[at] = False
            else:
                own[mover[a, at]] = at
            at = a
        surplus[at] -= 1
        surplus[end] += 1
    return own


#: Bins in which a price pass counts, and vectors that the driver holds to settle what prices leave over.
PRICE_BINS, HELD_KINDS = 256, 200_000


def _owners(sims: np.ndarray, price: np.ndarray) -> np.ndarray:
    return (sims - price).argmax(axis=1)


def _price_pass(kinds: DataFrame, prices: dict[int, np.ndarray], spans: dict[int, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """For each label and column the units whose best column it is, by how much its price could rise before they left, in bins of its span; those
    beyond the span are last."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for label, rows in pdf.groupby("label"):
                net = np.vstack(rows["sims"]) - prices[label]
                own, n, at = net.argmax(axis=1), rows["n"].to_numpy(), np.arange(len(net))
                best = net[at, own]
                net[at, own] = -np.inf
                slack = best - net.max(axis=1) if net.shape[1] > 1 else np.full(len(net), np.inf)
                cell = np.minimum(slack / spans[label][own] * PRICE_BINS, PRICE_BINS).astype(int)
                for c in np.unique(own).tolist():
                    mine = own == c
                    held[label, c] = held.get((label, c), 0) + np.bincount(cell[mine], n[mine], PRICE_BINS + 1)
        rows = [(label, c, b, int(n)) for (label, c), counts in held.items() for b, n in enumerate(counts) if n]
        yield pd.DataFrame(rows, columns=["label", "c", "b", "n"])

    told = kinds.select("label", "sims", "n").mapInPandas(count, "label int, c int, b int, n long")
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in told.groupBy("label", "c", "b").agg(F.sum("n").alias("n")).collect():
        out.setdefault((r["label"], r["c"]), np.zeros(PRICE_BINS + 1, dtype=np.int64))[r["b"]] = r["n"]
    return out


def _prices(kinds: DataFrame, places: dict[int, np.ndarray], passes: int = 60, enough: int = 256) -> dict[int, np.ndarray]:
    """Prices of the columns under which most vectors' best column has room: over-full columns raise theirs until, other prices as they are,
    just enough would stay. Each pass looks closer where the last edge lay."""
    prices = {label: np.zeros(len(p)) for label, p in places.items()}
    spans = {label: np.full(len(p), 4.0) for label, p in places.items()}
    least, idle = None, 0
    for _ in range(passes):
        counts = _price_pass(kinds, prices, spans)
        over = sum(max(0, int(n.sum()) - int(places[label][c])) for (label, c), n in counts.items())
        idle = 0 if least is None or over < least else idle + 1
        least = over if least is None else min(least, over)
        if all(int(n.sum()) - int(places[label][c]) <= enough for (label, c), n in counts.items()) or idle >= 12:
            break
        for (label, c), n in counts.items():
            if n.sum() > places[label][c]:
                stay = n[::-1].cumsum()[::-1]  # who would stay if the price rose to the lower edge of a bin
                edge = int(np.flatnonzero(stay >= places[label][c])[-1])
                width = spans[label][c] / PRICE_BINS
                prices[label][c] += edge * width
                spans[label][c] = spans[label][c] * 16 if edge == PRICE_BINS else max(2 * width, 1e-10)
    return prices


def _exchange(held: dict[int, tuple[np.ndarray, dict[int, int]]], surplus: np.ndarray, most: int) -> int:
    """Move units along cheapest chains of columns from over-full to open ones, up to ``most`` in all. ``held``: of each kind of vectors its
    similarities and its units by column, changed in place, as ``surplus`` is. Each step keeps the whole the best for its sizes (successive
    shortest paths); gives the units moved."""
    k = len(surplus)
    heaps: list[list[list[tuple[float, int]]]] = [[[] for _ in range(k)] for _ in range(k)]

    def push(kind: int, a: int) -> None:
        sims = held[kind][0]
        for b in range(k):
            if b != a:
                heapq.heappush(heaps[a][b], (float(sims[a] - sims[b]), kind))

    for kind, (_, units) in held.items():
        for a in units:
            push(kind, a)
    moved = 0
    while (surplus > 0).any() and moved < most:
        cost = np.full((k, k), np.inf)
        for a in range(k):
            for b in range(k):
                heap = heaps[a][b]
                while heap and not held[heap[0][1]][1].get(a):
                    heapq.heappop(heap)
                if heap:
                    cost[a, b] = heap[0][0]
        dist, back = np.where(surplus > 0, 0.0, np.inf), np.full(k, -1)
        for _ in range(k):
            through = dist[:, None] + cost
            better = through.min(axis=0) < dist - 1e-12
            if not better.any():
                break
            back[better] = through.argmin(axis=0)[better]
            dist = np.where(better, through.min(axis=0), dist)
        end = int(np.where(surplus < 0, dist, np.inf).argmin())
        path = [end]
        while back[path[-1]] >= 0 and not (surplus[path[-1]] > 0 and dist[path[-1]] == 0.0):
            path.append(int(back[path[-1]]))
        path.reverse()
        steps = [(a, b, heaps[a][b][0][1]) for a, b in zip(path, path[1:])]
        amount = int(min(surplus[path[0]], -surplus[end], most - moved, *(held[kind][1][a] for a, _, kind in steps)))
        for a, b, kind in steps:
            units = held[kind][1]
            units[a] -= amount
            if not units.get(b):
                units[b] = 0
                push(kind, b)
            units[b] += amount
        surplus[path[0]] -= amount
        surplus[end] += amount
        moved += amount
    return moved


def _movers(kinds: DataFrame, prices: dict[int, np.ndarray], asked: dict[int, int], settled: dict[int, set[int]]) -> list:
    """Of each label and pair of columns the kinds that lose least by going from one to the other, as many as hold the units asked for. A
    task leaves so many, and a rank of running units merges them; kinds in ``settled`` are left out."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for label, rows in pdf[pdf["label"].isin(asked.keys())].groupby("label"):
                rows = rows[~rows["first"].isin(settled.get(label, set()))]
                if not len(rows):
                    continue
                sims = np.vstack(rows["sims"])
                own, n, first = _owners(sims, prices[label]), rows["n"].to_numpy(), rows["first"].to_numpy()
                out = []
                for a in np.unique(own).tolist():
                    mine = np.flatnonzero(own == a)
                    for b in range(sims.shape[1]):
                        if b != a:
                            loss = sims[mine, a] - sims[mine, b]
                            order = np.lexsort((first[mine], loss))
                            before = n[mine][order].cumsum() - n[mine][order]
                            out += [(label, a, b, float(loss[o]), int(first[mine[o]]), int(n[mine[o]]), sims[mine[o]].tolist()) for o in order[before < asked[label]]]
                yield pd.DataFrame(out, columns=["label", "a", "b", "loss", "first", "n", "sims"])

    found = kinds.mapInPandas(near, "label int, a int, b int, loss double, first long, n long, sims array<double>")
    before = F.sum("n").over(Window.partitionBy("label", "a", "b").orderBy("loss", "first").rowsBetween(Window.unboundedPreceding, -1))
    asks = F.create_map(*(F.lit(x) for label, m in asked.items() for x in (label, m)))
    return found.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < asks[F.col("label")]).select("label", "a", "first", "n", "sims").distinct().collect()


def balanced_assignment(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """Vectors to their label's centres, with the greatest total similarity among all assignments whose sizes differ by at most one:
    ``vec_id, label, cluster``. ``centres``: label, cluster (numbered from 0), centre. The places above the floor go to the columns that most
    vectors like best. Similarities count to nine digits.

    Exact at any size, with no label in one task: vectors with equal similarities are one kind with a count; prices of the columns,
    raised in passes that count, give an assignment that is the best for its own sizes; the units that are still over go along cheapest
    chains of the kinds nearest to leaving, of which the driver holds at most about ``HELD_KINDS`` at a time. Ids differ."""
    lists = centres.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "centre"))), lambda s: s["centre"]).alias("centres"))
    rows = vectors.where("label is not null").select("vec_id", "label", "unit").join(lists, "label")
    rows = written(rows.select("vec_id", "label", F.transform("centres", lambda c: F.round(fn.dot(F.col("unit"), c), 9) + F.lit(0.0)).alias("sims")), "balance-rows")
    kinds = written(rows.groupBy("label", "sims").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")), "balance-kinds")
    best = F.array_position("sims", F.array_max("sims")) - 1
    liked: dict[int, np.ndarray] = {}
    for r in kinds.groupBy("label", F.size("sims").alias("k"), best.alias("c")).agg(F.sum("n").alias("n")).collect():
        liked.setdefault(r["label"], np.zeros(r["k"], dtype=np.int64))[r["c"]] = r["n"]
    places = {label: _places(n) for label, n in liked.items()}
    prices = _prices(kinds, places)
    sizes = {key: int(n.sum()) for key, n in _price_pass(kinds, prices, {label: np.full(len(p), 4.0) for label, p in places.items()}).items()}
    surplus = {label: np.array([sizes.get((label, c), 0) for c in range(len(p))]) - p for label, p in places.items()}
    held: dict[int, dict[int, tuple[np.ndarray, dict[int, int]]]] = {label: {} for label in places}
    while left := {label: int(s[s > 0].sum()) for label, s in surplus.items() if (s > 0).any()}:
        share = max(1, HELD_KINDS // sum(len(places[label]) ** 2 for label in left))
        asked = {label: min(n, share) for label, n in left.items()}
        # what has moved once stays with the driver; all else is where its best price is
        moved = {label: {kind: x for kind, x in kinds_.items() if set(x[1]) != {int(_owners(x[0][None], prices[label])[0])}} for label, kinds_ in held.items()}
        held = moved
        for r in _movers(kinds, prices, asked, {label: set(x) for label, x in moved.items()}):
            held[r["label"]][r["first"]] = (np.array(r["sims"]), {r["a"]: r["n"]})
        for label, n in asked.items():
            _exchange(held[label], surplus[label], n)
    final = [(label, x[0].tolist(), [(c, n) for c, n in sorted(x[1].items()) if n]) for label, all_ in held.items() for x in all_.values()]
    other = [x for x in final if len(x[2]) > 1 or x[2][0][0] != int(_owners(np.array(x[1])[None], prices[x[0]])[0])]

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for label, part in pdf.groupby("label"):
                yield pd.DataFrame({"vec_id": part["vec_id"], "label": label, "cluster": _owners(np.vstack(part["sims"]), prices[label])})

    shape = "vec_id long, label int, cluster int"
    if not other:
        return rows.mapInPandas(own, shape)
    listed = rows.sparkSession.createDataFrame(other, "label int, sims array<double>, shares array<struct<c:int,n:bigint>>")
    settled = rows.join(listed, ["label", "sims"]).select("vec_id", "label", "sims", "shares")
    # kinds with all units in one column need no order; in the others the smallest ids take the first columns
    at = F.transform("shares", lambda s, i: F.struct(s["c"].alias("c"), F.aggregate(F.slice("shares", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda n, x: n + x["n"]).alias("upto")))
    alone = settled.where(F.size("shares") == 1).select("vec_id", "label", F.col("shares")[0]["c"].alias("cluster"))
    split = numbered(settled.where(F.size("shares") > 1), ["label", "sims"], ["vec_id"])
    split = split.select("vec_id", "label", F.filter(at, lambda s: s["upto"] > F.col("number"))[0]["c"].alias("cluster"))
    rest = rows.join(listed.select("label", "sims"), ["label", "sims"], "left_anti").mapInPandas(own, shape)
    return rest.unionByName(alone).unionByName(split)


def _places(liked: np.ndarray) -> np.ndarray:
    """Places of each column from how many like it best: n // k, and one more for the ``n mod k`` that are liked most (the first of equals first)."""
    n, k = int(liked.sum()), len(liked)
    places = np.full(k, n // k)
    places[np.argsort(-liked, kind="stable")[: n % k]] += 1
    return places


def representatives(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each cluster's real vector nearest to its centre (smallest id of equals): ``label, cluster, vec_id, sim, size``."""
    key = F.struct("label", "cluster").alias("key")
    members = vectors.select("vec_id", "unit").join(clusters.select("vec_id", key), "vec_id")
    sims = members.join(prototypes(members, "key"), "key").select("key", "vec_id", F.round(fn.dot(F.col("unit"), F.col("proto")), 9).alias("sim"))
    best = sims.groupBy("key").agg(F.min(F.struct((-F.col("sim")).alias("s"), "vec_id")).alias("b"), F.count("*").alias("size"))
    return best.select("key.label", "key.cluster", "b.vec_id", (-F.col("b.s")).alias("sim"), "size")


def suppress_boxes(candidates: DataFrame, source: str, score: str, box: str, identity: str, most_iou: float, count: int) -> DataFrame:
    """Greedy choice per source: candidates from the best score down (smallest id of equals) stay unless they overlap one that stayed
    by more than ``most_iou``, until ``count`` stay. ``box`` is an array of four numbers. A source's candidates are one image's
    windows; they fold in one expression."""
    sides = lambda b: [b["box"][k] for k in range(4)]
    ranked = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(identity).alias("id"), F.col(box).alias("box"))))
    none = F.slice("ranked", 1, 0)
    free = lambda kept, c: (F.size(kept) < count) & F.forall(kept, lambda o: fn.box_iou(sides(o), sides(c)) <= most_iou)
    kept = F.aggregate("ranked", none, lambda kept, c: F.when(free(kept, c), F.concat(kept, F.array(c))).otherwise(kept))
    out = candidates.groupBy(source).agg(ranked.alias("ranked")).select(source, F.posexplode(kept).alias("slot", "c"))
    return out.select(source, "slot", F.col("c.id").alias(identity), (-F.col("c.s")).alias(score))


def match_partners(rows: DataFrame, batch: str, identity: str, group: str, neighbours: dict[int, list[int]], seed: int = 0) -> DataFrame:
    """A permutation of each batch, ``batch, id, partner, guided``: as many rows as possible get a partner whose group is a neighbour
    of their own (augmenting paths, in hash order); the rest share what is left in hash order. A batch is bounded by its maker."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id"])
        ids, groups = pdf["id"].to_numpy(), pdf["g"].to_numpy()
        able = [[j for j in range(len(ids)) if groups[j] in neighbours.get(int(g), ())] for g in groups]
        taken: dict[int, int] = {}

        def place(start: int) -> None:
            came, queue = {}, [start]
            for i in queue:
                for j in able[i]:
                    if j in came:
                        continue
                    came[j] = i
                    if j in taken:
                        queue.append(taken[j])
                        continue
                    while True:  # turn the path over
                        i = came[j]
                        before = next((x for x, y in taken.items() if y == i), None)
                        taken[j] = i
                        if i == start:
                            return
                        j = before

        for i in range(len(ids)):
            place(i)
        partner = {i: j for j, i in taken.items()}
        spare = iter([j for j in range(len(ids)) if j not in taken])
        full = [partner[i] if i in partner else next(spare) for i in range(len(ids))]
        return pd.DataFrame({"batch": pdf["b"].to_numpy(), "id": ids, "partner": ids[full], "guided": [i in partner for i in range(len(ids))]})

    keyed = rows.select(F.col(batch).cast("long").alias("b"), F.col(identity).cast("long").alias("id"), F.col(group).cast("int").alias("g"), fn.sampling_key(F.lit(seed), F.col(identity)).alias("h"))
    return keyed.groupBy("b").applyInPandas(match, "batch long, id long, partner long, guided boolean")


def _stable(items, key: str) -> list:
    """The items in the order of the SHA-256 of the key, a zero byte and the item."""
    return sorted(items, key=lambda x: (hashlib.sha256(f"{key}\0{x}".encode()).hexdigest(), x))


def guided_batch(ids: list[int], groups: list[int], donors: list[int], neighbours: dict[int, list[int]], key: str) -> tuple[list[int], list[bool]]:
    """A new permutation of one batch, and which rows were to be guided. ``donors`` is the one before, by id. Half of the rows (the smaller half), drawn in
    hash order, look for a donor of a neighbouring group; the others keep theirs, and only donors that none of them keeps are free. Receivers
    with the fewest free donors to choose from go first and may push others on (augmenting paths), so as many as can be are
    served; who is left over takes what is left over, both in hash order."""
    guided = set(_stable(ids, f"{key}\0guided")[: len(ids) // 2])
    group, donor = dict(zip(ids, groups)), dict(zip(ids, donors))
    free = set(ids) - {donor[r] for r in ids if r not in guided}
    able = {r: _stable([d for d in free if group[d] in neighbours.get(group[r], ())], f"{key}\0{r}") for r in guided}
    served: dict[int, int] = {}  # donor to receiver
    for start in sorted(_stable(guided, f"{key}\0order"), key=lambda r: len(able[r])):
        seen, path = set(), [(start, iter(able[start]))]
        came: list[int] = []  # the donor that each step of the path asks for
        while path:
            step = next((d for d in path[-1][1] if d not in seen), None)
            if step is None:
                path.pop()
                if came:
                    came.pop()
                continue
            seen.add(step)
            came.append(step)
            if step not in served:
                served.update({d: r for d, (r, _) in zip(came, path)})
                break
            path.append((served[step], iter(able[served[step]])))
    for r in guided:
        donor[r] = None
    for d, r in served.items():
        donor[r] = d
    left = zip(_stable([r for r in guided if donor[r] is None], f"{key}\0receivers"), _stable(free - set(served), f"{key}\0donors"))
    donor.update(dict(left))
    return [donor[r] for r in ids], [r in guided for r in ids]


def guided_partners(rows: DataFrame, batch: str, identity: str, group: str, partner: str, neighbours: dict[int, list[int]], key: str = "") -> DataFrame:
    """``batch, id, partner, guided, hit``: ``guided_batch`` of every batch of a pairing that is there already (``partner``: the donor of each row, a
    permutation within the batch, else ``ValueError``). ``hit``: the new donor's group is a neighbour. A batch is bounded by its maker."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, groups, donors = (pdf[c].astype(int).tolist() for c in ("id", "g", "p"))
        name = int(pdf["b"].iloc[0])
        if len(set(ids)) != len(ids) or sorted(donors) != ids:
            raise ValueError(f"batch {name} is no permutation")
        new, guided = guided_batch(ids, groups, donors, neighbours, f"{key}\0{name}")
        of = dict(zip(ids, groups))
        return pd.DataFrame({"batch": name, "id": ids, "partner": new, "guided": guided, "hit": [of[d] in neighbours.get(g, ()) for d, g in zip(new, groups)]})

    keyed = rows.select(F.col(batch).cast("long").alias("b"), F.col(identity).cast("long").alias("id"), F.col(group).cast("int").alias("g"), F.col(partner).cast("long").alias("p"))
    return keyed.groupBy("b").applyInPandas(match, "batch long, id long, partner long, guided boolean, hit boolean")


def balanced_clusters(vectors: DataFrame, k: int, seed: int = 0, most: int = 20_000, rounds: int = 3) -> DataFrame:
    """``k`` clusters a label of equal size, give or take one: k-means centres, then ``rounds`` of balanced assignment, each from the centres that
    the one before has left. The driver holds the centres between rounds."""
    from . import spherical_kmeans

    found = spherical_kmeans(vectors, k, seed, most)
    units = vectors.select("vec_id", "unit")
    for _ in range(rounds):
        centres = prototypes(units.join(found.select("vec_id", F.struct("label", "cluster").alias("key")), "vec_id"), "key")
        number = F.row_number().over(Window.partitionBy("key.label").orderBy("key.cluster")) - 1
        rows = centres.select("key.label", number.alias("cluster"), F.col("proto").alias("centre"))
        held = vectors.sparkSession.createDataFrame(rows.collect(), rows.schema)
        found = balanced_assignment(vectors, held)
    return found
