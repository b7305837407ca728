"""Mini-batch k-means for many k at once: one pass over the data serves all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .dense import matrix

#: Vectors that initial centres are drawn from, draws of each k, and steps over the data.
SAMPLE_ROWS, DRAWS, STEPS, LEAST_BATCH = 4096, 3, 24, 256


def spaced(low: int, high: int, steps: int) -> list[int]:
    """Distinct whole numbers at equal distances."""
    return sorted({int(k) for k in np.linspace(low, high, steps)})


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres drawn one by one with chances by squared distance, the best of a few draws after some full rounds."""
    best, least = x[:1], np.inf
    for _ in range(DRAWS):
        c = [x[rng.integers(len(x))]]
        d = ((x - c[0]) ** 2).sum(axis=1)
        while len(c) < k:
            c.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
            d = np.minimum(d, ((x - c[-1]) ** 2).sum(axis=1))
        c = np.array(c)
        for _ in range(10):
            d2 = ((x * x).sum(1)[:, None] - 2 * x @ c.T) + (c * c).sum(1)
            near = d2.argmin(axis=1)
            n = np.bincount(near, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        cost = float((((x * x).sum(1)[:, None] - 2 * x @ c.T) + (c * c).sum(1)).min(axis=1).sum())
        if cost < least:
            best, least = c, cost
    return best


def _near(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d2 = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
    near = d2.argmin(axis=1)
    return near, np.maximum(d2[np.arange(len(x)), near], 0.0)


def minibatch_kmeans(points: DataFrame, ks: list[int], seed: int = 42, steps: int = STEPS) -> dict[int, np.ndarray]:
    """Centres by k for ``points`` (id, v).

    A step takes the rows of one batch, drawn by a hash of their ids, and moves every centre of every k towards the
    mean of its rows there by their share of all rows it has had so far. Tasks send one sum for each centre; what the
    driver holds is the models.
    """
    spark = points.sparkSession
    good = settle(points.where("v IS NOT NULL").select("id", F.col("v").cast("array<double>").alias("v")))
    n = good.count()
    sample = np.array([r.v for r in good.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE_ROWS).select("v").collect()])
    rng = np.random.default_rng(seed)
    models = {k: _seeds(sample, k, rng) for k in ks}
    seen = {k: np.full(len(c), len(sample) / max(1, len(c)) / 4) for k, c in models.items()}
    batches = max(1, min(steps, n // LEAST_BATCH))
    for step in range(steps):
        now = spark.sparkContext.broadcast(models)

        def sums(parts: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = {k: (np.zeros_like(c), np.zeros(len(c), np.int64)) for k, c in now.value.items()}
            for b in parts:
                x = matrix(b.column("v"))
                for k, c in now.value.items() if len(x) else ():
                    near, _ = _near(x, c)
                    np.add.at(total[k][0], near, x)
                    total[k][1][:] += np.bincount(near, minlength=len(c))
            rows = [(k, i, s[i].tolist(), int(m[i])) for k, (s, m) in total.items() for i in range(len(s)) if m[i]]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.float64())), pa.array(cols[3], pa.int64())], ["k", "centre", "s", "n"])

        part = good.where(F.pmod(F.xxhash64(F.lit(seed + 1 + step // batches), "id"), F.lit(batches)) == step % batches)
        flat = part.select("v").mapInArrow(sums, "k int, centre int, s array<double>, n bigint").select("k", "centre", "n", F.posexplode("s").alias("i", "x"))
        got = flat.groupBy("k", "centre", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).groupBy("k", "centre").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
        models = {k: c.copy() for k, c in models.items()}
        for r in got.collect():  # one row for each centre
            seen[r.k][r.centre] += r.n
            mean = np.array([p.x for p in r.s]) / r.n
            models[r.k][r.centre] += (mean - models[r.k][r.centre]) * (r.n / seen[r.k][r.centre])
        now.unpersist()
    return models


def assigned(points: DataFrame, models: dict[int, np.ndarray]) -> DataFrame:
    """``points`` (id, v, ...) once for each k, with ``k``, ``cluster`` and the squared ``distance`` to its centre."""
    now = points.sparkSession.sparkContext.broadcast(models)
    kinds = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["v"].tolist(), float)
            for k, c in now.value.items() if len(b) else ():
                near, d = _near(x, c)
                yield b.assign(k=k, cluster=near, distance=d)

    return points.where("v IS NOT NULL").mapInPandas(run, f"{kinds}, k int, cluster int, distance double")
