"""Inference over all groups at once: signed-rank p-values, clustered bootstraps and power, without a row on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .sampling import draw
from .statistics import mcnemar_exact

#: Differences up to which the null distribution is exact, where there are no ties and no zeros.
EXACT = 50
#: Terms of the series of the error function: enough for arguments up to 6, beyond which the tail is 0 to 16 places.
TERMS = 150
#: Chances of at most k under Poisson(1).
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10)]


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, by a series of positive terms."""
    z = F.least(x, F.lit(6.0))
    step = lambda s, k: F.struct((s["t"] * 2 * z * z / (2 * k + 1)).alias("t"), (s["sum"] + s["t"] * 2 * z * z / (2 * k + 1)).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.struct(z.alias("t"), z.alias("sum")), step, lambda s: s["sum"])
    return F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * total)


def signed_rank_tail(n: Column, w: Column) -> Column:
    """How many sets of the ranks 1 to n have a sum of at most w: coefficients of the product of (1 + x^r)."""
    upto = F.sequence(F.lit(0), F.greatest(w.cast("int"), F.lit(0)))
    one = F.transform(upto, lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    more = lambda ways, r: F.transform(ways, lambda c, i: c + F.when(i >= r, F.get(ways, (i - r).cast("int"))).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), one, more)
    return F.aggregate(ways, F.lit(0.0), lambda s, x: s + x)


def signed_rank(df: DataFrame, by: list[str], diff: str, zeros: str = "wilcox") -> DataFrame:
    """(by, n, w_plus, w_minus, p, exact) of the signed-rank test of each group's differences.

    Ranks come from counts by distinct size, which are made where the rows are. Zeros are dropped (``wilcox``) or
    ranked and then dropped (``pratt``). Up to ``EXACT`` differences without ties or zeros have the exact null
    distribution, others the normal one with corrections for both. A group without differences has p = 1.
    """
    c = df.where(F.col(diff).isNotNull()).groupBy(*by, F.abs(diff).alias("m")).agg(F.count("*").alias("k"), F.sum((F.col(diff) > 0).cast("bigint")).alias("plus"))
    ranked = c if zeros == "pratt" else c.where("m > 0")
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*by).orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = ranked.withColumn("rank", before + (F.col("k") + 1) / 2.0).withColumn("real", F.col("m") > 0)
    k = F.col("k").cast("double")
    s = r.groupBy(*by).agg(
        F.sum("k").alias("n"),
        F.sum(F.when(F.col("real"), F.col("plus") * F.col("rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("real"), (F.col("k") - F.col("plus")) * F.col("rank")).otherwise(0.0)).alias("w_minus"),
        F.sum(F.when(~F.col("real"), F.col("k")).otherwise(0)).alias("z"),
        F.sum(F.when(F.col("real"), k * k * k - k).otherwise(0.0)).alias("ties"),
    )
    every = df.select(*by).distinct().join(s, by, "left") if by else s
    n, z, w = F.coalesce("n", F.lit(0)), F.coalesce("z", F.lit(0)), F.least("w_plus", "w_minus")
    exact = (n <= EXACT) & (F.coalesce("ties", F.lit(0.0)) == 0) & (z == 0)
    mean = n * (n + 1) / 4 - z * (z + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - z * (z + 1) * (2 * z + 1) / 24 - F.col("ties") / 48
    p = (
        F.when(n - z == 0, 1.0)
        .when(exact, F.least(F.lit(1.0), 2 * signed_rank_tail(F.when(exact, n).otherwise(0), F.when(exact, w).otherwise(0)) / F.pow(F.lit(2.0), n)))
        .otherwise(F.when(var > 0, erfc(F.abs(w - mean) / F.sqrt(2 * F.greatest(var, F.lit(1e-300))))).otherwise(1.0))
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return every.select(*by, n.alias("n"), zero("w_plus"), zero("w_minus"), p.alias("p"), exact.alias("exact"))


def cluster_slopes(df: DataFrame, cluster: str, x: str, y: str, rounds: int, seed: str) -> DataFrame:
    """(round, slope): slopes of y on x over clusters drawn again with Poisson(1) counts; round 0 is the slope itself.

    Each cluster is five sums, which is all that a slope needs: no row is drawn, and a round adds up clusters. A
    count comes from a checksum of seed, cluster and round, so it doesn't depend on where a cluster is.
    """
    good = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = good.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    drawn = settle(sums).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    u = draw(seed, cluster, "round")
    count = sum([(u >= p).cast("double") for p in POISSON], F.lit(0.0))
    drawn = drawn.withColumn("w", F.when(F.col("round") == 0, 1.0).otherwise(count))
    a = drawn.groupBy("round").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    below = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    return a.select("round", F.when(below > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / below).alias("slope"))


#: Rounds of a block of simulated tests, and the grid of drops.
BLOCK, STEP = 100, 0.02


def detectable_drop(groups: DataFrame, by: str, rho: float, power: float = 0.8, alpha: float = 0.05, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(by, mde) for groups (by, n, base): the smallest drop of a share, on a grid, that paired exact McNemar tests of n
    pairs find with that power; null if none does.

    Pairs share their latent number with chance ``rho``. All groups bisect their grids together, one batch of
    simulated tests a step. A block's random stream is named by seed, group and block, and uses the same numbers
    for every drop, so the result is the same however the rows are dealt out.
    """
    blocks = -(-rounds // BLOCK)
    state = groups.select(by, F.col("n").cast("bigint").alias("n"), F.col("base").cast("double").alias("base"))
    state = settle(state.withColumn("hi", F.floor(F.col("base") / STEP - 1e-9).cast("int")).withColumn("most", F.col("hi") + 1).withColumn("lo", F.lit(1)).withColumn("hi", F.col("most")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, h, n, base, mid, block in b.itertuples(index=False):
                low = base - mid * STEP
                both = rho * low + (1 - rho) * base * low
                worse, better = base - both, max(low - both, 0.0)
                r = np.random.Generator(np.random.Philox(key=[(seed ^ h) & (2**64 - 1), block]))
                mine = min(BLOCK, rounds - block * BLOCK)
                x = r.binomial(n, min(1.0, worse + better), mine)  # discordant pairs, then those that got worse
                y = r.binomial(x, worse / max(worse + better, 1e-300))
                out.append((name, sum(mcnemar_exact(int(k), int(m - k)) < alpha for m, k in zip(x, y, strict=True))))
            yield pd.DataFrame(out, columns=[by, "hits"])

    longest = max(1, math.ceil(math.log2(1 / STEP + 1)))
    kind = dict(groups.dtypes)[by]
    for _ in range(longest):
        asked = state.where("lo < hi").select(by, F.xxhash64(by).alias("h"), "n", "base", F.expr("(lo + hi) div 2").cast("int").alias("mid"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        hits = asked.mapInPandas(run, f"`{by}` {kind}, hits bigint").groupBy(by).agg(F.sum("hits").alias("hits"))
        mid, found = F.expr("(lo + hi) div 2").cast("int"), F.col("hits") >= power * rounds
        new = state.join(hits, by, "left")
        state = settle(new.select(by, "n", "base", "most", F.when(~found, mid + 1).otherwise(F.col("lo")).alias("lo"), F.when(found, mid).otherwise(F.col("hi")).alias("hi")))
    return state.select(by, F.when(F.col("lo") < F.col("most"), F.round(F.col("lo") * STEP, 6)).alias("mde"))
