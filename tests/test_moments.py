"""Sums over all pairs without a pair."""

import numpy as np
import pytest

from scopelens.operators import dense


@pytest.mark.parametrize("twice", [False, True])
def test_moments_of_all_pairs(spark, twice):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6)) + 0.3
    ids = [i % 50 if twice else i for i in range(120)]
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(500, None)]
    got = dense.moments(spark.createDataFrame(rows, "id bigint, v array<double>").repartition(5)).first()
    other = np.array(ids)[:, None] != np.array(ids)
    s = (x @ x.T)[other]
    assert got.n == other.sum() and got.total == pytest.approx(s.sum()) and got.squares == pytest.approx((s * s).sum())


def test_moments_make_no_cells(spark):
    plan = dense.moments(spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, 1.0])], "id bigint, v array<double>"))._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan
