"""Every registered query runs, and equals its SQL where it has one."""

import os

import duckdb
import pytest

from deltaview.plans.registry import QUERIES, SQL

SF = os.environ.get("DELTAVIEW_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(plain(v) for v in r) for r in got.select(*cols).collect()), key=key)
    b = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in want.fetchall()), key=key)
    assert a == b


def test_qualification_reads_all_orders_and_items(spark, duck):
    """Every brand a supplier ships and every brand a customer orders, whatever the quantity and the price."""
    has, needs = (
        dict(duck.execute(f"SELECT {who}, list(DISTINCT p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1").fetchall()) for who in ("l_suppkey", "o_custkey")
    )
    want = {(c, j, len(set(x) & set(y)), len(y)) for c, x in has.items() for j, y in needs.items() if set(x) & set(y)}
    assert {tuple(r) for r in QUERIES["qualification"](spark, SF).select("candidate", "job", "matched", "required").collect()} == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
