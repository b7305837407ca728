"""Aggregations that stay distributed where a plain window would gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_position(df: DataFrame, key: str, bins: int = 4096) -> DataFrame:
    """Adds ``position``, the row's place (from 0) in the order of a numeric key.

    Rows are counted by equal-width bins of the key; running sums over the bins give each bin's offset, and
    rows are numbered within their bin.
    """
    ends = df.agg(F.min(key).cast("double").alias("_lo"), F.max(key).cast("double").alias("_hi"))  # one row
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300)) / bins
    binned = df.crossJoin(F.broadcast(ends)).withColumn("_bin", F.floor((F.col(key) - F.col("_lo")) / width)).drop("_lo", "_hi")
    sums = binned.groupBy("_bin").agg(F.count("*").alias("_n"))
    before = sums.select("_bin", (F.sum("_n").over(Window.orderBy("_bin")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy(key)) - 1
    return binned.withColumn("_in", inside).join(F.broadcast(before), "_bin").withColumn("position", (F.col("_before") + F.col("_in")).cast("bigint")).drop("_bin", "_in", "_before")


def nearest_rank(df: DataFrame, by: str, value: str, shares: dict[str, float], bins: int = 2048) -> DataFrame:
    """(by, one column per share): the value at place round(share * (n - 1)), half to even, of each group in order.

    A histogram of ``bins`` bins finds the bin of each place; only that bin's rows are numbered.
    """
    ends = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    width = F.greatest((F.col("_hi") - F.col("_lo")) / bins, F.lit(1e-300))
    rows = df.where(F.col(value).isNotNull()).select(by, value).join(ends, by).withColumn("_bin", F.floor((F.col(value) - F.col("_lo")) / width))
    hist = rows.groupBy(by, "_bin").agg(F.count("*").alias("_c"))
    run = hist.withColumn("_before", F.sum("_c").over(Window.partitionBy(by).orderBy("_bin")) - F.col("_c")).join(ends.select(by, "_n"), by)
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.bround(F.lit(s) * (F.col("_n") - 1)).cast("bigint").alias("place")) for k, s in shares.items()]))
    goal = run.withColumn("_w", wanted).where((F.col("_before") <= F.col("_w.place")) & (F.col("_w.place") < F.col("_before") + F.col("_c")))
    goal = goal.select(by, "_bin", F.col("_w.name").alias("_name"), (F.col("_w.place") - F.col("_before")).alias("_at"))
    picked = rows.join(goal.select(by, "_bin").distinct(), [by, "_bin"], "left_semi").withColumn("_i", F.row_number().over(Window.partitionBy(by, "_bin").orderBy(value)) - 1)
    hit = picked.join(goal, [by, "_bin"]).where("_i = _at")
    return hit.groupBy(by).agg(*[F.max(F.when(F.col("_name") == k, F.col(value))).alias(k) for k in shares])


def pareto(df: DataFrame, cost: str, gain: str, key: str) -> DataFrame:
    """Rows whose gain exceeds that of all cheaper ones. For summaries: one row per system."""
    w = Window.orderBy(cost, F.desc(gain), key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_best", F.max(gain).over(w)).where(F.col("_best").isNull() | (F.col(gain) > F.col("_best"))).drop("_best")


def modal(df: DataFrame, by: str, label: str) -> DataFrame:
    """The most frequent label of each group, the smallest among equals."""
    n = df.groupBy(by, label).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.min_by(label, F.struct((-F.col("n")).alias("a"), F.col(label).alias("b"))).alias(label), F.max("n").alias("n"))


def mean_missing(value: str, missing: str) -> Column:
    """Mean with nulls as zeros (``zero``) or left out (``skip``)."""
    return F.avg(F.coalesce(F.col(value), F.lit(0.0))) if missing == "zero" else F.avg(value)
