"""Every registered query of the library against its SQL, on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from quillmere.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("compare", Path(__file__).parents[1] / "tools" / "compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the standard tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in compare.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(compare.norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert rows
        return
    rel = con.sql(ORACLE_SQL[name])
    order = [rel.columns.index(c) for c in cols]
    assert cols == sorted(rel.columns)
    assert rows == sorted((tuple(compare.norm(r[k]) for k in order) for r in rel.fetchall()), key=repr)
