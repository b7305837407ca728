"""Mini-batch k-means against full k-means, its agreement scores, and the queries of the learning part by value."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from scopelens.operators import clustering
from scopelens.operators import statistics as st
from scopelens.plans import QUERIES


def test_minibatches_cost_no_more_than_full_rounds(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 8)) * 2
    x = centres[rng.integers(0, 9, 3000)] + rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id bigint, v array<double>").repartition(4)
    ks = clustering.spaced(2, 12, 4)
    assert ks == [2, 5, 8, 12]
    models = clustering.minibatch_kmeans(df, ks)
    cost = {r.k: (r.c, r.n) for r in clustering.assigned(df, models).groupBy("k").agg(F.sum("distance").alias("c"), F.count("*").alias("n")).collect()}
    full = df.where("v IS NOT NULL").withColumn("x", array_to_vector("v")).cache()
    for k in ks:
        best = min(KMeans(featuresCol="x", k=k, seed=s, maxIter=30).fit(full).summary.trainingCost for s in (1, 2))
        assert cost[k][1] == 3000 and cost[k][0] <= 1.05 * best, k
    full.unpersist()
    again = clustering.minibatch_kmeans(df.repartition(2), [5])
    assert np.allclose(np.sort(again[5], axis=0), np.sort(clustering.minibatch_kmeans(df, [5])[5], axis=0), atol=1e-6)


def test_agreement_by_group_is_that_of_each(spark):
    rng = np.random.default_rng(6)
    rows = [(g, int(a), int(b), 1) for g in "xy" for a, b in rng.integers(0, 3, (200, 2))] + [("same", i % 4, i % 4, 5) for i in range(8)] + [("one", 0, 0, 3)]
    df = spark.createDataFrame(rows, "g string, a int, b int, n bigint").groupBy("g", "a", "b").agg(F.sum("n").alias("n"))
    got = {r.g: (r.nmi, r.homogeneity) for r in st.agreement_by(df, ["g"]).collect()}
    for g in "xy":
        one = st.agreement(df.where(F.col("g") == g)).first()
        assert got[g] == pytest.approx((one.nmi, one.homogeneity), abs=1e-6)
    assert got["same"] == (1.0, 1.0) and got["one"] == (1.0, 1.0)


def test_granularity_on_the_driver_tables(spark, sf_dir):
    rows = {r.k: r for r in QUERIES["minibatch_granularity"](spark, sf_dir).collect()}
    assert sorted(rows) == clustering.spaced(4, 12, 5)
    cost = [rows[k].inertia for k in sorted(rows)]
    assert all(a > b > 0 for a, b in zip(cost, cost[1:], strict=False))
    nmi = {k: r.nmi_label for k, r in rows.items()}
    best = max(nmi, key=lambda k: (nmi[k], -k))
    assert {r.best_k for r in rows.values()} == {best}
    fine = rows[max(rows)]
    assert {r.verdict for r in rows.values()} == {"fine" if fine.nmi_label > fine.nmi_parity + 0.05 else "coarse"}
    assert all(0 <= r.nmi_label <= 1 and 0 <= r.homogeneity_parity <= 1 for r in rows.values())
