"""Column expressions on vectors, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """``v`` at length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def mean_pool(df: DataFrame, keys: list[str], vector: str, normalise: bool = True) -> DataFrame:
    """One row per key with ``v``, the mean of its vectors: exploded by position, so any number of rows pre-aggregate."""
    flat = df.select(*keys, F.posexplode(doubles(vector)).alias("pos", "x"))
    mean = flat.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    out = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"))
    return out.withColumn("v", unit(F.col("v"))) if normalise else out
