"""Statistics against known values and against plain restatements."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from scopelens.operators import statistics as st


@pytest.mark.parametrize(("b", "c", "p"), [(14, 9, 0.4048728942871094), (15, 5, 0.04138946533203125), (0, 0, 1.0)])
def test_mcnemar(b, c, p):
    assert st.mcnemar_exact(b, c) == pytest.approx(p, abs=1e-12)


def test_fisher_of_a_known_table():
    assert st.fisher_exact(3, 1, 1, 3) == pytest.approx(34 / 70, abs=1e-12)


def test_wilcoxon_small_exact():
    w, p = st.wilcoxon_signed_rank(np.array([1.0, 2.0, 3.0, 4.0, 5.0]))
    assert (w, p) == (0.0, 2 / 32)
    assert st.wilcoxon_signed_rank(np.zeros(3)) == (0.0, 1.0)


def test_holm_is_monotone(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double").selectExpr("*", "1 AS family")
    got = {r.k: r.p_holm for r in st.holm(df, "p", ["family"], "k").collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1, 10), (2, 30), (2, 20), (4, 40)], "x int, y int")
    r = df.select(st.average_rank("x").alias("a"), st.average_rank("y").alias("b")).selectExpr("corr(a, b) AS r").first().r
    assert r == pytest.approx(0.948683, abs=1e-6)


@given(s.lists(s.floats(-5, 5), min_size=3, max_size=30))
@settings(max_examples=20, deadline=None)
def test_permutation_is_a_share(d):
    assert 0 <= st.permutation_p(np.array(d), rounds=200) <= 1


def test_bootstrap_brackets_the_mean():
    v = np.random.default_rng(0).normal(1, 1, 200)
    lo, hi = st.bootstrap_ci(v, rounds=2000)
    assert lo < v.mean() < hi


def test_extreme_value_fit_recovers_a_line():
    n = np.array([10, 100, 1000, 10_000])
    a, b, r2 = st.extreme_value_fit(n, 0.3 + 0.07 * np.sqrt(2 * np.log(n)))
    assert (a, b, r2) == pytest.approx((0.3, 0.07, 1.0))


def test_agreement_of_equal_labellings(spark):
    r = st.agreement(spark.createDataFrame([(0, 5, 10), (1, 6, 7), (2, 7, 3)], "a int, b int, n int")).first()
    assert (r.nmi, r.ari, r.homogeneity, r.purity) == (1.0, 1.0, 1.0, 1.0)


def test_nearest_rank_rounds_half_to_even(spark):
    from scopelens.operators.aggregates import nearest_rank

    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", float(x)) for x in range(1, 7)] + [("c", 7.0)] * 9, "g string, v double")
    assert {r.g: r.p for r in nearest_rank(df, "g", "v", {"p": 0.5}).collect()} == {"a": 3.0, "b": 3.0, "c": 7.0}


def test_pareto(spark):
    from scopelens.operators.aggregates import pareto

    df = spark.createDataFrame([(1, 0.5, "a"), (2, 0.4, "b"), (3, 0.6, "c")], "cost int, gain double, k string")
    assert sorted(r.k for r in pareto(df, "cost", "gain", "k").collect()) == ["a", "c"]


def test_resampling_agrees_with_the_plain_tests(spark):
    rng = np.random.default_rng(4)
    d = rng.normal(0.12, 1, 150)
    df = spark.createDataFrame([("x", "y", i, float(v)) for i, v in enumerate(d)], "a string, b string, q bigint, d double").repartition(3)
    r = st.resampled(df, ["a", "b"], "q", "d", 4000, "signs").toPandas()
    p = float((np.abs(r["s"] / len(d)) >= abs(d.mean()) - 1e-12).mean())
    assert p == pytest.approx(st.permutation_p(d, rounds=4000), abs=0.05)
    b = st.resampled(df, ["a", "b"], "q", "d", 2000, "poisson").toPandas()
    lo, hi = np.quantile(b["s"] / b["w"], [0.025, 0.975])
    want = st.bootstrap_ci(d, rounds=4000)
    assert (lo, hi) == pytest.approx(want, abs=0.06)


def test_mcnemar_tails():
    exact = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))
    for b in range(0, 40, 3):
        for c in range(0, 90, 7):
            assert st.mcnemar_exact(b, c) == pytest.approx(exact(b, c), rel=1e-10)
    assert st.mcnemar_exact(480, 560) == pytest.approx(exact(480, 560), rel=1e-9)
    assert 0.004 < st.mcnemar_exact(49_600, 50_500) < 0.005


def test_mcnemar_halves_round_up(spark):
    """p of 7 and 1 pairs is 0.0703125, which sums of rounded terms miss."""
    from fractions import Fraction
    from math import comb

    pairs = [(b, c) for b in range(13) for c in range(13) if b + c]
    got = spark.createDataFrame(pairs, "b bigint, c bigint").select("b", "c", F.round(st.mcnemar_p("b", "c"), 6).alias("p")).collect()
    for b, c, p in got:
        exact = min(Fraction(1), Fraction(2 * sum(comb(b + c, i) for i in range(min(b, c) + 1)), 2 ** (b + c)))
        assert p == float(Fraction(int(exact * 10**6 + Fraction(1, 2)), 10**6)), (b, c)


def test_fisher_against_whole_numbers():
    from fractions import Fraction
    from math import comb

    rng = np.random.default_rng(8)
    tables = [(0, 0, 0, 0), (5, 0, 0, 5), (0, 9, 0, 4), (300, 10, 20, 200), (1, 1000, 1000, 1)] + [tuple(map(int, rng.integers(0, 60, 4))) for _ in range(150)]
    for a, b, c, d in tables:
        r1, r2, k = a + b, c + d, a + c
        p = {x: Fraction(comb(r1, x) * comb(r2, k - x), comb(r1 + r2, k)) for x in range(max(0, k - r2), min(k, r1) + 1)}
        want = sum(q for q in p.values() if q <= p[a] * (1 + Fraction(1, 10**7)))
        assert st.fisher_exact(a, b, c, d) == pytest.approx(float(min(1, want)), rel=1e-9, abs=1e-300)


def test_fisher_of_large_tables_takes_no_time():
    import time

    start = time.time()
    assert 0 < st.fisher_exact(400_300, 600_000, 399_000, 600_500) < 1
    assert time.time() - start < 5


def test_fisher_walks_no_further_than_chances_count():
    """Steps grow with the standard deviation, not with the table: a walk through all tables takes half a minute."""
    import time

    start = time.time()
    assert st.fisher_exact(*[100_000_000] * 4) == pytest.approx(1.0, abs=1e-9)
    assert st.fisher_exact(100_005_000, 100_000_000, 100_000_000, 100_000_000) == pytest.approx(0.802666, abs=1e-6)
    assert time.time() - start < 5


def test_fisher_without_labels(spark, tmp_path):
    from scopelens.plans import QUERIES

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [tuple(r) for r in QUERIES["fisher_exact_p"](spark, str(tmp_path)).collect()] == [(0, 0, 0, 0, 1.0)]


def test_tied_means_of_many_rows(spark, tmp_path):
    """0.1 three times and 0.3 in one order or another have the mean 0.1 each; as doubles these differ."""
    from scopelens.plans import QUERIES

    rows = [(i, q, s, v) for i, (q, s, v) in enumerate([(q, "a", v) for q in range(4) for v in (0.1, 0.2, 0.3)] + [(q, "b", v) for q in range(4) for v in (0.3, 0.2, 0.1)] + [(9, "a", 1.0), (9, "b", 3.0)])]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double").repartition(1).sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["effect_size_dz"](spark, str(tmp_path)).collect()
    assert [(r.better, r.worse, r.tied) for r in got] == [(0, 1, 4)]
