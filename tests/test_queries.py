"""Every query with SQL must equal it; every other one must run and have a stable schema."""

import pytest

import scopelens.plans as plans
from tests.oracle import connect, rows

ROWS_ONLY = sorted(set(plans.QUERIES) - set(plans.ORACLES))


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    want = con.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _close(rows(got), rows(want))


def _close(a: list, b: list) -> bool:
    return len(a) == len(b) and all(len(x) == len(y) and all(_same(u, v) for u, v in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


def _same(u, v) -> bool:
    if isinstance(u, float) or isinstance(v, float):
        return u is not None and v is not None and abs(float(u) - float(v)) <= 2e-5 * max(1.0, abs(float(u)))
    return u == v


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    assert df.columns
    assert df.count() > 0
