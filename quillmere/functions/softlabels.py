"""Column functions on probability vectors beyond the basic ones: pooling by parent, committees, orders, mass maps. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import entropy, let, log_sum_exp, normalised_entropy, sampling_key, total


def rescaled(p: Column) -> Column:
    """Non-negative numbers divided by their sum; null where that is zero."""
    return let(p, lambda v: let(total(v), lambda whole: F.when(whole > 0, F.transform(v, lambda x: x / whole))))


def centred(v: Column) -> Column:
    return let(v, lambda w: let(total(w) / F.size(w), lambda mean: F.transform(w, lambda x: x - mean)))


def equivalent_logits(p: Column, temperature: float, floor: float = 1e-30) -> Column:
    """Logits, centred, whose softmax at ``temperature`` is ``p``."""
    return centred(F.transform(p, lambda x: temperature * F.log(F.greatest(x, F.lit(floor)))))


def places_of_parent(parent_of: list[int], parent: int) -> list[int]:
    return [k for k, q in enumerate(parent_of) if q == parent]


def entropy_within_parent(p: Column, parent_of: list[int], parent: Column) -> Column:
    """Entropy over the places of ``parent``, rescaled to one, as a share of its largest value."""
    choice = F.lit(None).cast("double")
    for q in sorted(set(parent_of)):
        own = rescaled(F.array(*(F.element_at(p, k + 1) for k in places_of_parent(parent_of, q))))
        choice = F.when(parent == q, normalised_entropy(own)).otherwise(choice)
    return choice


def pooled_logits(z: Column, parent_of: list[int]) -> Column:
    """Log-sum-exp of each parent's logits, centred over the parents."""
    pools = [F.array(*(F.element_at(z, k + 1) for k in places_of_parent(parent_of, q))) for q in sorted(set(parent_of))]
    return centred(F.array(*(log_sum_exp(pool) for pool in pools)))


def committee(members: list[Column], scores: list[float], divisor: float = 10.0) -> Column:
    """Members' vectors weighted by the softmax of their scores over ``divisor``."""
    powers = [F.exp(F.lit((s - max(scores)) / divisor)) for s in scores]
    whole = sum(powers[1:], powers[0])
    weighted = lambda m, w: F.transform(m, lambda x: x * w / whole)
    parts = [weighted(m, w) for m, w in zip(members, powers)]
    mixed = parts[0]
    for part in parts[1:]:
        mixed = F.zip_with(mixed, part, lambda x, y: x + y)
    return mixed


def one_hot(place: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == place, 1.0).otherwise(0.0))


def reordered(p: Column, target: Column, destination: Column) -> Column:
    """The target's value stays; the others, from the largest down, go to the places ``destination`` lists."""
    ranked = F.sort_array(F.filter(p, lambda x, i: i != target), asc=False)
    placed = lambda s, d: F.transform(p, lambda x, i: F.when(i == target, x).otherwise(F.element_at(s, F.array_position(d, i).cast("int"))))
    return let(ranked, lambda s: let(destination, lambda d: placed(s, d)))


def derangement(identity: Column, seed: int, target: Column, n: int) -> Column:
    """Where each place's value goes: others than ``target`` move one step along a circle in the identity's own hash order, so none
    stays (with two others or more) and the target does."""
    keyed = F.array(*(F.struct(sampling_key(F.lit(seed), identity, F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(n)))
    circle = F.transform(F.array_sort(F.filter(keyed, lambda s: s["i"] != target)), lambda s: s["i"])
    after = lambda c, i: F.element_at(c, (F.array_position(c, i) % F.size(c) + 1).cast("int"))
    return let(circle, lambda c: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == target, i).otherwise(after(c, i))))


def mass_map(mass: Column, width: int, floor: float = 1e-15) -> Column:
    """Entropy (as a share of its largest value) and centroid (y, x) of a map given row by row; null where it holds no mass."""

    def measured(p: Column) -> Column:
        y = total(F.transform(p, lambda v, i: v * F.floor(i / width)))
        x = total(F.transform(p, lambda v, i: v * (i % width)))
        return F.struct(normalised_entropy(p).alias("entropy"), y.alias("y"), x.alias("x"))

    return let(mass, lambda m: let(total(m), lambda whole: F.when(whole > floor, let(F.transform(m, lambda v: v / whole), measured))))


# ---- densities along an axis ---------------------------------------------------------------------


def interpolate(xs: Column, ys: Column, x: Column) -> Column:
    """Piecewise-linear value at ``x`` of the curve through rising ``xs``; its end values beyond them."""
    below = F.size(F.filter(xs, lambda v: v <= x))
    at = lambda a, k: F.element_at(a, k)
    inner = lambda k: at(ys, k) + (at(ys, k + 1) - at(ys, k)) * (x - at(xs, k)) / (at(xs, k + 1) - at(xs, k))
    return F.when(below == 0, at(ys, F.lit(1))).when(below >= F.size(xs), at(ys, F.size(xs))).otherwise(inner(F.greatest(F.least(below, F.size(xs) - 1), F.lit(1))))


def interval_density(n: int, start: Column, end: Column, background: float) -> Column:
    """One inside [start, end), ``background`` elsewhere, scaled to mean one."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((i >= start) & (i < end), 1.0).otherwise(background))
    return let(raw, lambda v: let(total(v) / n, lambda mean: F.transform(v, lambda x: x / mean)))


def allocate(weights: Column, whole: Column, least: float, most: float, steps: int = 80) -> Column:
    """Shares proportional to ``weights``, clamped to [least, most], that add up to ``whole``: the scale is bisected. Null where
    the bounds leave no such allocation."""
    clamped = lambda s: F.transform(weights, lambda w: F.greatest(F.lit(least), F.least(F.lit(most), w * s)))
    high = most / F.greatest(F.array_min(F.filter(weights, lambda w: w > 0)), F.lit(1e-12))
    halve = lambda a, _: let((a["lo"] + a["hi"]) / 2, lambda m: let(total(clamped(m)) < whole, lambda low: F.struct(F.when(low, m).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(m).alias("hi"))))
    scale = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), high.alias("hi")), halve)["hi"]
    possible = (whole >= F.size(weights) * least) & (whole <= total(clamped(high)) + 1e-9)
    return F.when(possible, let(scale, clamped))


def best_window(grid: Column, width: int, size: int) -> Column:
    """(mean, y, x) of the ``size`` by ``size`` window with the largest mean of a grid given row by row, the first of equals."""
    places = [(y, x) for y in range(width - size + 1) for x in range(width - size + 1)]
    mean = lambda y, x: total(F.transform(F.lit([(y + a) * width + x + b for a in range(size) for b in range(size)]), lambda k: F.element_at(grid, k + 1))) / (size * size)
    tried = F.array(*(F.struct((-F.round(mean(y, x), 9)).alias("m"), F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in places))
    return let(F.array_min(tried), lambda b: F.struct((-b["m"]).alias("mean"), b["y"].alias("y"), b["x"].alias("x")))


__all__ = ["allocate", "best_window", "centred", "committee", "derangement", "entropy", "entropy_within_parent", "equivalent_logits", "interpolate", "interval_density", "mass_map", "one_hot", "places_of_parent", "pooled_logits", "reordered", "rescaled"]
