"""Joins of runs and ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def system_pairs(df: DataFrame, query: str, system: str, value: str) -> DataFrame:
    """(a, b, query, d): the difference of every two systems, a before b by name, on each query that both answered."""
    a = df.select(query, F.col(system).alias("a"), F.col(value).alias("_x"))
    b = df.select(query, F.col(system).alias("b"), F.col(value).alias("_y"))
    return a.join(b, query).where("a < b").select("a", "b", query, (F.col("_x") - F.col("_y")).alias("d"))


def answered_by_all(df: DataFrame, query: str, system: str) -> DataFrame:
    """Queries that every system of ``df`` has."""
    n = df.agg(F.countDistinct(system).alias("_all"))  # one row
    per = df.select(query, system).distinct().groupBy(query).agg(F.count("*").alias("_n"))
    return per.crossJoin(F.broadcast(n)).where("_n = _all").select(query)


def average_present(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join of (key, a) and (key, b) with the mean of what is present."""
    return a.join(b, key, "full_outer").withColumn("mean", (F.coalesce("a", "b") + F.coalesce("b", "a")) / 2.0)


def choose_by_threshold(df: DataFrame, confidence: str, thresholds: list[float], first: str, second: str) -> DataFrame:
    """Every row at every threshold: ``second`` where the confidence is below it."""
    t = df.withColumn("tau", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    low = F.col(confidence) < F.col("tau")
    return t.withColumn("fallback", low).withColumn("chosen", F.when(low, F.col(second)).otherwise(F.col(first)))
