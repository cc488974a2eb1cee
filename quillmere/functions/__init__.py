"""Column functions on vectors, probabilities, boxes and identity hashes. All are built-in expressions: no UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once a row. The body of a lambda is evaluated for every element, with all it
    mentions, so what does not depend on the element must be bound outside."""
    return F.transform(F.array(value), body)[0]


# ---- vectors -------------------------------------------------------------------------------------


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def normalised(v: Column) -> Column:
    """The vector at length one; null where its length is zero."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def first_arg_max(v: Column) -> Column:
    """0-based place of the largest element, the first of equals."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


# ---- probabilities -------------------------------------------------------------------------------


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp((x - top) / temperature)))
    return let(powers, lambda e: let(total(e), lambda whole: F.transform(e, lambda x: x / whole)))


def log_sum_exp(v: Column) -> Column:
    return let(v, lambda w: let(F.array_max(w), lambda top: top + F.log(total(F.transform(w, lambda x: F.exp(x - top))))))


def entropy(p: Column) -> Column:
    """Nats; zero probabilities add nothing."""
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def normalised_entropy(p: Column) -> Column:
    return entropy(p) / F.log(F.size(p).cast("double"))


def negative_log(p: Column, floor: float = 1e-30) -> Column:
    return -F.log(F.greatest(p, F.lit(floor)))


def kl_divergence(p: Column, q: Column, floor: float = 1e-30) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * (F.log(x) - F.log(F.greatest(y, F.lit(floor))))).otherwise(0.0)))


def jensen_shannon_bits(p: Column, q: Column) -> Column:
    bits = lambda mean: (kl_divergence(p, mean) + kl_divergence(q, mean)) / 2.0 / F.log(F.lit(2.0))
    return let(F.zip_with(p, q, lambda x, y: (x + y) / 2.0), bits)


def others(p: Column, target: Column) -> Column:
    """The distribution without ``target`` (0-based), rescaled to one."""
    rest = F.filter(p, lambda x, i: i != target)
    return let(rest, lambda o: let(total(o), lambda whole: F.transform(o, lambda x: x / whole)))


def keep_top(p: Column, k: int) -> Column:
    """The ``k`` largest (first of equals first) as they are, the rest's mass shared evenly among the others."""
    n = F.size(p)
    ranked = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))

    def smoothed(top: Column) -> Column:
        share = (1.0 + total(F.transform(top, lambda s: s["x"]))) / F.greatest(n - k, F.lit(1))
        spread = lambda places: let(share, lambda rest: F.transform(p, lambda x, i: F.when(F.array_contains(places, i), x).otherwise(rest)))
        return let(F.transform(top, lambda s: s["i"]), spread)

    return F.when(n <= k, p).otherwise(let(F.slice(ranked, 1, k), smoothed))


def order_of_others(p: Column, target: Column) -> Column:
    """Places other than ``target`` by falling probability, ties by place."""
    ranked = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.filter(F.transform(ranked, lambda s: s["i"]), lambda i: i != target)


def marginalised(p: Column, parent_of: list[int]) -> Column:
    """Probabilities summed by parent, in order of parent; ``parent_of`` has each place's."""
    places = [[k for k, q in enumerate(parent_of) if q == parent] for parent in sorted(set(parent_of))]
    return F.array(*(sum((F.element_at(p, k + 1) for k in own), F.lit(0.0)) for own in places))


# ---- identity hashes -----------------------------------------------------------------------------


def sampling_key(*parts: Column) -> Column:
    """SHA-256 over the parts joined by NUL, as hex: sorting by it is a draw that depends on identity alone."""
    return F.sha2(F.concat_ws("\x00", *(p.cast("string") for p in parts)), 256)


def identity_seed(*parts: Column) -> Column:
    """The first 8 bytes of ``sampling_key``, little-endian, without the top bit."""
    hex_ = sampling_key(*parts)
    pairs = [F.substring(hex_, 2 * k + 1, 2) for k in range(7, -1, -1)]
    top = F.conv(pairs[0], 16, 10).cast("bigint").bitwiseAND(F.lit(127))
    rest = F.conv(F.concat(*pairs[1:]), 16, 10).cast("bigint")
    return F.shiftleft(top, 56).bitwiseOR(rest)


def gumbel(*parts: Column) -> Column:
    """-ln(-ln u) for the identity's own u in (0, 1)."""
    u = (identity_seed(*parts).cast("double") + 0.5) / F.lit(float(2**63))
    u = F.least(F.greatest(u, F.lit(1e-300)), F.lit(1.0 - 2.0**-53))
    return -F.log(-F.log(u))


# ---- boxes ---------------------------------------------------------------------------------------


def box_area(b: list[Column]) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def box_clip(b: list[Column], width: Column, height: Column) -> list[Column]:
    zero = F.lit(0.0)
    return [F.greatest(zero, F.least(b[0], width)), F.greatest(zero, F.least(b[1], height)), F.greatest(zero, F.least(b[2], width)), F.greatest(zero, F.least(b[3], height))]


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    return box_area([F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])])


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap over union; 0 where both are empty."""
    both = box_overlap(a, b)
    union = box_area(a) + box_area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


# ---- predicates and guards -----------------------------------------------------------------------


def finite(x: Column) -> Column:
    """``x`` where it is a finite number, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def same(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= tolerance


def sign_class(x: Column, epsilon: float) -> Column:
    return F.when(x > epsilon, "+").when(x < -epsilon, "-").otherwise("tie")


def difference_hash(grid: Column, width: int) -> Column:
    """A bit for each two neighbours in a row of a square grid, given row by row: is the right one larger? At most 64 bits."""
    bits = [F.when(grid[y * width + x] < grid[y * width + x + 1], F.lit(1 << y * (width - 1) + x)).otherwise(F.lit(0)).cast("long") for y in range(width) for x in range(width - 1)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return code


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r as an aggregate; null where a side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
