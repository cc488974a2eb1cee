"""Structured Streaming forms of the library's mergeable summaries. An extension: the semantics are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(events: DataFrame, by: str, at: str = "ts", value: str = "value", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, sum and sum of squares of each key and window; later merges give mean and deviation. State older than the watermark goes."""
    w = F.window(at, window)
    g = events.withWatermark(at, late).groupBy(w.alias("w"), by)
    return g.agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).select(F.col("w.start").alias("start"), by, "n", "s", "q")


def first_of_each(events: DataFrame, keys: list[str], at: str = "ts", late: str = "2 hours") -> DataFrame:
    """Replayed log records once each, within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def moments(parts: DataFrame, by: str) -> DataFrame:
    """Merge partial moments into mean and population deviation."""
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    return parts.groupBy(by).agg(n.alias("n"), (s / n).alias("mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("sd"))
