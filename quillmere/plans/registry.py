"""Where queries register themselves with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``table``, which reads a table by name."""

    def add(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        run.__name__, run.__doc__ = name, make.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return make

    return add


def r(x, digits: int = 6):
    """Rounded, so that the order of summation does not show; never a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def unit_vectors(table) -> DataFrame:
    """Labelled vectors in double precision at length one."""
    e = table("embeddings").where("embedding is not null and label is not null")
    return e.select("vec_id", "label", fn.normalised(fn.doubles(F.col("embedding"))).alias("unit")).where("unit is not null")


#: DuckDB: the same vectors, prototypes and similarities as common table expressions.
UNIT_SQL = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS d FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
u AS (SELECT vec_id, label, list_transform(d, lambda x: x / sqrt(list_sum(list_transform(d, lambda y: y * y)))) AS unit FROM e)"""
PROTO_SQL = (
    UNIT_SQL
    + """,
s AS (SELECT label, pos, sum(unit[pos]) AS x FROM u, range(1, 65) AS t(pos) GROUP BY label, pos),
g AS (SELECT label, list(x ORDER BY pos) AS v FROM s GROUP BY label),
p AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS proto FROM g),
sims AS (SELECT vec_id, u.label AS label, p.label AS p_label, list_dot_product(unit, proto) AS sim FROM u, p)"""
)
