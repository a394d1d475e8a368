"""Every graph query over the driver's tables against its SQL in DuckDB."""

import math
import os
from pathlib import Path

import pytest

from graphloom import tpch

DIR = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DIR.is_dir(), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in DIR.iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(tpch.queries()))
def test_query(spark, duck, name):
    df = tpch.queries()[name](spark, str(DIR))
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    run = duck.execute(tpch.oracle_sql()[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in run.fetchall()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.queries()["flagship"](spark, str(DIR)).columns == ["nation", "customers"]


def test_whole_tables(spark, duck):
    """Queries over all orders and nations; insertion order shows in the rows' own order."""
    q = tpch.queries()
    got = [tuple(r) for r in q["order_by_insertion_all"](spark, str(DIR)).collect()]
    assert got == duck.execute(tpch.oracle_sql()["order_by_insertion_all"]).fetchall() and len({k for k, _ in got}) > 1
    lines = duck.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    assert len(got) == lines == q["duration_between_all"](spark, str(DIR)).count()
    assert q["use_graph_all"](spark, str(DIR)).count() == duck.execute("SELECT count(*) FROM nation").fetchone()[0]
    assert q["triangle_all"](spark, str(DIR)).first()["n"] > q["triangle"](spark, str(DIR)).first()["n"]
