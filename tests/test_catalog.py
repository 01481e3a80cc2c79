"""Every query over bars against SQL written apart, on the smallest tables."""

import datetime

import duckdb
import pytest

from tessera.plans import catalog

from .conftest import SF


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("lineitem", "part", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _norm(v):
    return None if v is None or v != v else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)[:10] if isinstance(v, datetime.date) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, oracle, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = oracle.execute(f"select {', '.join(columns)} from ({catalog.ORACLES[name]}) z").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(map(_norm, r)) for r in got.select(*columns).collect()), key=key) == sorted((tuple(map(_norm, r)) for r in want), key=key)


@pytest.mark.parametrize("name", ["execute_dynamic_tilt", "feature_matrix", "liquidity_panels"])
def test_no_product_of_tables(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
