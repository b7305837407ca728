"""Signed ranks against plain enumeration, clustered bootstraps against plain resampling, power against its formula."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopelens.operators import inference
from scopelens.operators import statistics as st


def plain_ranks(d, zeros):
    d = [x for x in d if x] if zeros == "wilcox" else list(d)
    order = sorted(range(len(d)), key=lambda i: abs(d[i]))
    rank = [0.0] * len(d)
    for _, g in itertools.groupby(order, key=lambda i: abs(d[i])):
        g = list(g)
        mean = sum(order.index(i) + 1 for i in g) / len(g)
        for i in g:
            rank[i] = mean
    return d, rank


@pytest.mark.parametrize("zeros", ["wilcox", "pratt"])
def test_signed_ranks_by_group(spark, zeros):
    rng = np.random.default_rng(1)
    groups = {
        "one": [2.5], "pair": [1.0, -2.0], "five": [1.0, 2.0, 3.0, 4.0, 5.0], "none": [None, None], "zeros": [0.0, 0.0, 0.0],
        "exact": rng.permutation(np.arange(1, 51) * rng.choice([-1, 1], 50)).tolist(), "more": rng.normal(0.3, 1, 120).tolist(),
        "ties": rng.integers(-4, 6, 60).astype(float).tolist(), "small ties": [1.0, 1.0, -1.0, 2.0, 0.0], "far": [float(i) for i in range(1, 400)],
    }
    rows = [(k, None if x is None else float(x)) for k, v in groups.items() for x in v]
    got = {r.g: r for r in inference.signed_rank(spark.createDataFrame(rows, "g string, d double").repartition(5), ["g"], "d", zeros).collect()}
    assert set(got) == set(groups)
    for name, d in groups.items():
        kept, rank = plain_ranks([x for x in d if x is not None], zeros)
        plus, minus = sum(r for x, r in zip(kept, rank, strict=True) if x > 0), sum(r for x, r in zip(kept, rank, strict=True) if x < 0)
        assert (got[name].n, got[name].w_plus, got[name].w_minus) == (len(kept), plus, minus), name
        if name in ("none", "zeros"):
            assert got[name].p == 1.0
            continue
        _, p = st.wilcoxon_signed_rank(np.array([x for x in d if x is not None]), zeros)
        assert got[name].p == pytest.approx(p, abs=1e-9), name


def test_exact_tails_are_those_of_all_sign_choices(spark):
    for n in range(1, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(0, n * (n + 1) // 2 + 1, 3):
            assert spark.range(1).select(inference.signed_rank_tail(F.lit(n), F.lit(float(w)))).first()[0] == sum(x <= w for x in sums)


def test_error_function(spark):
    x = [0.0, 1e-9, 0.3, 1.0, 2.5, 4.0, 5.9, 6.0, 40.0]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(inference.erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(v) for v in x], abs=1e-12)


def test_cluster_slopes_against_plain_resampling(spark):
    rng = np.random.default_rng(3)
    rows = []
    for q in range(80):
        shift = rng.normal(0, 2)
        rows += [(q, float(x), float(-0.7 * x + shift * (x - 2) / 4 + rng.normal(0, 0.3))) for x in rng.uniform(0, 4, int(rng.integers(3, 9)))]
    df = spark.createDataFrame([*rows, (999, None, 1.0)], "q bigint, x double, y double").repartition(7)
    got = inference.cluster_slopes(df, "q", "x", "y", 600, "s").toPandas().set_index("round").slope.sort_index()
    x, y, q = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    assert got[0] == pytest.approx(np.polyfit(x, y, 1)[0], abs=1e-9) and len(got) == 601
    plain = []
    for _ in range(600):
        pick = rng.integers(0, 80, 80)
        at = np.concatenate([np.flatnonzero(q == i) for i in pick])
        plain.append(np.polyfit(x[at], y[at], 1)[0])
    for share in (0.025, 0.5, 0.975):
        assert np.quantile(got[1:], share) == pytest.approx(np.quantile(plain, share), abs=0.06)
    again = inference.cluster_slopes(df.repartition(2), "q", "x", "y", 20, "s").toPandas().set_index("round").slope.sort_index()
    assert np.allclose(again[:21], got[:21])


def test_power_is_the_same_however_groups_are_dealt(spark):
    groups = [("a", 30, 0.6), ("b", 150, 0.6), ("c", 1000, 0.6), ("d", 12, 0.1), ("e", 100_000, 0.5)]
    df = spark.createDataFrame(groups, "g string, n bigint, base double")
    one = {r.g: r.mde for r in inference.detectable_drop(df.repartition(5), "g", 0.62).collect()}
    assert one == {r.g: r.mde for r in inference.detectable_drop(df.coalesce(1), "g", 0.62).collect()}
    assert one["a"] > one["b"] > one["c"] >= one["e"] == 0.02 and one["d"] is None
    # The drop found has the power asked for, and the one before it hasn't, by the normal approximation within a step.
    drop, n, base = one["b"], 150, 0.6
    power = []
    for d in (drop - 2 * inference.STEP, drop + 2 * inference.STEP):
        low = base - d
        both = 0.62 * low + 0.38 * base * low
        b, c = base - both, low - both
        z = (math.sqrt(n) * (b - c) - 1.96 * math.sqrt(b + c)) / math.sqrt(b + c - (b - c) ** 2)
        power.append(0.5 * math.erfc(-z / math.sqrt(2)))
    assert power[0] < 0.8 < power[1]
