"""Statistics: what aggregates can express as DataFrames, exact p-values and resampling on numpy."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(x: str, *by: str) -> Column:
    """Rank from 1, ties sharing their mean; within ``by`` (meant for per-group or small inputs)."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2.0


def auc_by(df: DataFrame, group: str, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by Mann-Whitney.

    Ranks come from counts by distinct score, so a large group is pre-aggregated before its window.
    """
    by = df.groupBy(group, score).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("bigint")).alias("p"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = by.withColumn("rank", before + (F.col("n") + 1) / 2.0)
    pos, neg = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    return r.groupBy(group).agg(F.round((F.sum(F.col("p") * F.col("rank")) - pos * (pos + 1) / 2.0) / (pos * neg), 6).alias("auc"))


def holm(df: DataFrame, p: str, family: list[str], order: str) -> DataFrame:
    """Adds ``p_holm``: the running maximum of (m - rank + 1) p in the order of p, at most 1."""
    w = Window.partitionBy(*family).orderBy(p, order)
    m = F.count("*").over(Window.partitionBy(*family))
    return df.withColumn("_w", F.col(p) * (m - F.row_number().over(w) + 1)).withColumn("p_holm", F.least(F.max("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_w")


#: Pairs up to which tails are summed in whole numbers. More pairs have longer fractions than seven places.
WHOLE = 64


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided exact p of b and c discordant pairs: the terms of the lower tail, from its largest down.

    Few pairs are counted in whole numbers, since their p may end in a 5 in the seventh place, which must not be missed.
    """
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    if n <= WHOLE:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    total = term = 1.0
    for i in range(k, 0, -1):
        term *= i / (n - i + 1)
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, 2 * total * math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)))


def mcnemar_p(b: str, c: str) -> Column:
    """``mcnemar_exact`` of two columns of counts, in batches."""

    @F.pandas_udf("double")
    def p(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([mcnemar_exact(int(i), int(j)) for i, j in zip(x, y, strict=True)], dtype="float64")

    return p(b, c)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p: tables with the same margins that are no more probable.

    Chances are relative to the most probable table's, from which both sides are walked by ratios of neighbours until
    nothing is left to add, some tens of standard deviations away. That is where they leave the normal doubles: the least
    of the others times a ratio above a half is itself again, so a walk down to 0 would be as long as the table is large.
    """
    least = sys.float_info.min
    r1, r2, k = a + b, c + d, a + c
    low, high = max(0, k - r2), min(k, r1)
    mode = min(high, max(low, (r1 + 1) * (k + 1) // (r1 + r2 + 2)))
    up, down = [1.0], []
    x = mode
    while x < high and up[-1] > least:
        up.append(up[-1] * ((r1 - x) / (x + 1)) * ((k - x) / (r2 - k + x + 1)))
        x += 1
    x, last = mode, 1.0
    while x > low and last > least:
        last *= (x / (r1 - x + 1)) * ((r2 - k + x) / (k - x + 1))
        down.append(last)
        x -= 1
    at = a - mode
    here = (up[at] if at < len(up) else 0.0) if at >= 0 else (down[-at - 1] if -at <= len(down) else 0.0)
    every = sorted(up + down)
    return min(1.0, math.fsum(q for q in every if q <= here * (1 + 1e-7)) / math.fsum(every))


def fisher_p(a: str, b: str, c: str, d: str) -> Column:
    """``fisher_exact`` of four columns of counts, in batches."""

    @F.pandas_udf("double")
    def p(*cells: pd.Series) -> pd.Series:
        return pd.Series([fisher_exact(*map(int, x)) for x in zip(*cells, strict=True)], dtype="float64")

    return p(a, b, c, d)


def wilcoxon_signed_rank(diffs: np.ndarray, zeros: str = "wilcox") -> tuple[float, float]:
    """(W, two-sided p). Exact for up to 50 untied differences, else the normal approximation with tie correction."""
    d = np.asarray(diffs, float)
    if zeros == "wilcox":
        d = d[d != 0]
    n = len(d)
    if n == 0:
        return 0.0, 1.0
    order = np.argsort(np.abs(d), kind="stable")
    a = np.abs(d)[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    count = np.diff(np.r_[first, n])
    rank = np.empty(n)
    rank[order] = np.repeat(first + (count + 1) / 2, count)
    plus, minus = rank[d > 0].sum(), rank[d < 0].sum()
    w = float(min(plus, minus))
    z0 = int((d == 0).sum())
    if n <= 50 and (count == 1).all() and not z0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return w, float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    mean = n * (n + 1) / 4 - z0 * (z0 + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - z0 * (z0 + 1) * (2 * z0 + 1) / 24 - (count**3 - count)[a[first] > 0].sum() / 48
    return w, float(math.erfc(abs(w - mean) / math.sqrt(2 * var))) if var > 0 else 1.0


def permutation_p(diffs: np.ndarray, rounds: int = 10_000, seed: int = 42) -> float:
    """Paired sign-flip test: the share of sign choices whose mean is at least as far from 0."""
    d = np.asarray(diffs, float)
    rng = np.random.default_rng(seed)
    here = abs(d.mean())
    hits = 0
    for a in range(0, rounds, 1000):
        s = rng.integers(0, 2, size=(min(1000, rounds - a), len(d))) * 2 - 1
        hits += int((np.abs((s * d).mean(axis=1)) >= here - 1e-12).sum())
    return hits / rounds


def bootstrap_ci(values: np.ndarray, rounds: int = 10_000, seed: int = 42, level: float = 0.95) -> tuple[float, float]:
    v = np.asarray(values, float)
    rng = np.random.default_rng(seed)
    means = np.concatenate([v[rng.integers(0, len(v), size=(min(500, rounds - a), len(v)))].mean(axis=1) for a in range(0, rounds, 500)])
    return float(np.quantile(means, (1 - level) / 2)), float(np.quantile(means, (1 + level) / 2))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Chances of at most k under Poisson(1).
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)])


def resampled(df: DataFrame, by: list[str], row: str, value: str, rounds: int, kind: str) -> DataFrame:
    """(by, round, s, w): sums of weighted values and of weights in each of many resamplings.

    A row's weight in a round is a hash of its number and the round: a sign (``signs``) or a Poisson(1) count
    (``poisson``). Batches add up all rounds as arrays, so what is shuffled is one row per batch and group.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = _mixed(np.arange(rounds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for b in batches:
            for key, g in b.groupby(by, sort=False):
                ids, v = g[row].to_numpy().astype(np.int64).view(np.uint64), g[value].to_numpy(float)
                s, w = np.zeros(rounds), np.zeros(rounds)
                for a in range(0, len(v), 512):
                    h = _mixed(ids[a : a + 512, None] ^ salt)
                    weight = np.where(h >> np.uint64(63) == 1, 1.0, -1.0) if kind == "signs" else np.searchsorted(_POISSON, h / 2.0**64, side="right").astype(float)
                    s += v[a : a + 512] @ weight
                    w += weight.sum(axis=0)
                yield pd.DataFrame([(*key, s.tolist(), w.tolist())], columns=[*by, "s", "w"])

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["s array<double>", "w array<double>"])
    parts = df.select(*by, row, value).mapInPandas(run, schema)
    flat = parts.select(*by, F.posexplode(F.arrays_zip("s", "w")).alias("round", "x"))
    return flat.groupBy(*by, "round").agg(F.sum("x.s").alias("s"), F.sum("x.w").alias("w"))


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, slope, intercept, r, se) of y on x."""
    return df.agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"),
        F.sqrt((1 - F.corr(x, y) * F.corr(x, y)) * F.regr_syy(y, x) / F.regr_sxx(y, x) / (F.count("*") - 2)).alias("se"),
    )


def extreme_value_fit(sizes: np.ndarray, maxima: np.ndarray) -> tuple[float, float, float]:
    """(a, b, r2) of maxima = a + b sqrt(2 ln n)."""
    x, y = np.sqrt(2 * np.log(np.asarray(sizes, float))), np.asarray(maxima, float)
    b = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    a = y.mean() - b * x.mean()
    return float(a), float(b), float(1 - ((y - a - b * x) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def agreement(contingency: DataFrame) -> DataFrame:
    """NMI (arithmetic mean), ARI, homogeneity and purity from counts (a, b, n) of two labellings: a is the truth."""
    c = contingency
    rows = c.groupBy("a").agg(F.sum("n").alias("n"))
    cols = c.groupBy("b").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    ent = lambda df, name: df.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nln"), F.sum(F.col("n") * (F.col("n") - 1) / 2.0).alias("pairs")).select(*[F.col(x).alias(f"{name}_{x}") for x in ("total", "nln", "pairs")])
    one = ent(c, "c").crossJoin(ent(rows, "r")).crossJoin(ent(cols, "k")).crossJoin(cols.agg(F.sum("most").alias("most")))
    n = F.col("c_total").cast("double")
    h = lambda x: F.log(n) - F.col(f"{x}_nln") / n
    mi = h("r") + h("k") - h("c")
    expected = F.col("r_pairs") * F.col("k_pairs") / (n * (n - 1) / 2)
    return one.select(
        F.round(F.when(h("r") + h("k") == 0, 1.0).otherwise(2 * mi / (h("r") + h("k"))), 6).alias("nmi"),
        F.round((F.col("c_pairs") - expected) / ((F.col("r_pairs") + F.col("k_pairs")) / 2 - expected), 6).alias("ari"),
        F.round(F.when(h("r") == 0, 1.0).otherwise(mi / h("r")), 6).alias("homogeneity"),
        F.round(F.col("most") / n, 6).alias("purity"),
    )


def agreement_by(contingency: DataFrame, by: list[str]) -> DataFrame:
    """(by, nmi, homogeneity) of each group's counts (a, b, n) of two labellings: a is the truth."""
    ent = lambda keys, name: contingency.groupBy(*by, *keys).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum("n").alias(f"{name}_n"), F.sum(F.col("n") * F.log("n")).alias(f"{name}_nln"))
    j = ent(["a", "b"], "c").join(ent(["a"], "r"), by).join(ent(["b"], "k"), by)
    h = lambda x: F.log("c_n") - F.col(f"{x}_nln") / F.col("c_n")
    mi = h("r") + h("k") - h("c")
    both = h("r") + h("k")
    return j.select(*by, F.round(F.when(both < 1e-12, 1.0).otherwise(2 * mi / both), 6).alias("nmi"), F.round(F.when(h("r") < 1e-12, 1.0).otherwise(mi / h("r")), 6).alias("homogeneity"))
