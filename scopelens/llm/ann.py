"""Approximate nearest neighbours: a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by its ``PREFIX`` nearest pivots in order
and posted, with their places, in the inverted files of these pivots. A query accumulates, over its own
pivots' files, PREFIX minus the difference of places, which orders the vectors by Spearman's footrule with
missing pivots at place PREFIX. The best share of each shard is reranked by exact inner products.

That share is set by an audit: ``AUDIT`` queries find their true neighbours by brute force and note how far
down the footrule order each lies; the share covers ``RECALL`` of them, whatever it takes, up to all vectors.
A shard's inverted files are built once, written to the shared folder, and met by every block of queries.

Equal vectors are indexed once with their ``k + 1`` smallest ids, which is all that a list of k can show of
them. Vectors that are null, zero, or hold null or non-finite components take no part. All vectors must have
one length. Repeated ids are rows of their own, of which none is a candidate of its own id. Empty tables
give empty results; other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tune
from .vectors import block_count, distinct_vectors, indexes, matrix, meet, shard_count, unpacked, valid

PIVOTS, PREFIX = 1024, 128
AUDIT, RECALL, LEAST_SHARE = 96, 0.96, 0.02


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The PREFIX nearest pivots of each vector, nearest first."""
    prefix, out = min(PREFIX, len(pivots)), []
    for a in range(0, len(x), 4096):
        near = _unit(x[a : a + 4096]) @ pivots.T
        top = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1).astype(np.int32))
    return np.concatenate(out)


def _files(pivots: np.ndarray):
    """A shard's vectors and ids, and its inverted files: items and places, by pivot."""

    def build(t: pa.Table) -> dict[str, np.ndarray]:
        x, ids = matrix(t.column("embedding")), t.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        flat = nearest(x, pivots).reshape(-1)
        order = np.argsort(flat, kind="stable")
        prefix = min(PREFIX, len(pivots))
        return {
            "x": x, "first": ids.offsets.to_numpy(), "ids": ids.values.to_numpy(),
            "item": (order // prefix).astype(np.int32), "place": (order % prefix).astype(np.int32), "begin": np.searchsorted(flat[order], np.arange(len(pivots) + 1)),
        }

    return build


def _agreement(files: dict[str, np.ndarray], pivots: np.ndarray) -> np.ndarray:
    """For one query's pivots: the greater, the smaller the footrule distance of a vector."""
    begin, n = files["begin"][pivots], files["begin"][pivots + 1] - files["begin"][pivots]
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    near = len(pivots) - np.abs(files["place"][at] - np.repeat(np.arange(len(pivots)), n))
    return np.bincount(files["item"][at], near, len(files["x"])).astype(np.int64)


def _search(k: int, pivots: np.ndarray, share: float | None):
    """A cell's function. With no share: the k true neighbours and how far down the footrule order they are."""

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_o, out_v, out_s, out_f = [], [], [], [], []
        if len(data) and len(queries):
            files, q = unpacked(data), matrix(queries.column("embedding"))
            x, first, flat = files["x"], files["first"], files["ids"]
            for row, own, vector, near in zip(queries.column("query_id").to_pylist(), queries.column("own").to_pylist(), q, nearest(q, pivots), strict=True):
                agree = _agreement(files, near)
                if share is None:
                    pick = np.arange(len(x))
                else:
                    take = min(len(x), max(math.ceil(share * len(x)), k))
                    least = np.partition(agree, len(x) - take)[len(x) - take]
                    pick = np.flatnonzero(agree >= least)
                # Row by row in one order of additions, so equal vectors get equal scores wherever they are.
                score = (x[pick] * vector).sum(axis=1)
                if len(pick) > k + 1:
                    cutoff = np.partition(score, len(pick) - k - 1)[len(pick) - k - 1]
                    pick, score = pick[score >= cutoff], score[score >= cutoff]
                n = first[pick + 1] - first[pick]
                vec = flat[np.repeat(first[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                score, pick = np.repeat(score, n), np.repeat(pick, n)
                other = vec != own
                vec, score, pick = vec[other], score[other], pick[other]
                best = np.lexsort((vec, -score))[:k]
                out_q += [row] * len(best)
                out_o += [own] * len(best)
                out_v.append(vec[best])
                out_s.append(score[best])
                if share is None:
                    out_f.append(np.array([(agree > agree[i]).sum() / len(x) for i in pick[best]]))
        cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        table = {"query_id": pa.array(out_q, pa.int64()), "own": pa.array(out_o, pa.int64()), "vec_id": pa.array(cat(out_v, np.int64)), "score": pa.array(cat(out_s, np.float64))}
        if share is None:
            table["depth"] = pa.array(cat(out_f, np.float64))
        return pa.table(table)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` its k nearest of ``vectors`` by inner product.

    Both have vec_id and embedding; a vector is no candidate of a query with its own id.
    """
    spark = vectors.sparkSession
    tune(spark)
    data = cut(distinct_vectors(valid(vectors), k + 1).withColumn("key", F.element_at("ids", 1)))
    # A query is a row: rows that share an id get lists of their own.
    asked = cut(valid(queries).select(F.monotonically_increasing_id().alias("query_id"), F.col("vec_id").alias("own"), "embedding"))
    n, m = data.count(), asked.count()
    schema = "query_id bigint, own bigint, vec_id bigint, score double"
    if not n or not m:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = data.orderBy(F.xxhash64("key"), "key").limit(PIVOTS).collect()
    pivots = _unit(np.array([r.embedding for r in sample], np.float64))
    dim = pivots.shape[1]
    shards, blocks = shard_count(n, dim), block_count(m, dim)
    files = indexes(data, "key", shards, _files(pivots))
    share = audited_share(files, asked, pivots, n, shards, k)
    found = meet(files, asked, shards, blocks).applyInArrow(_search(k, pivots, share), schema)
    return _best(found, k).select(F.col("own").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def audited_share(files: DataFrame, asked: DataFrame, pivots: np.ndarray, n: int, shards: int, k: int) -> float:
    """The share of each shard that has RECALL of the true neighbours of a sample of the queries."""
    audit = asked.orderBy(F.xxhash64("own"), "own", "query_id").limit(AUDIT)
    depths = _best(meet(files, audit, shards, 1).applyInArrow(_search(k, pivots, None), "query_id bigint, own bigint, vec_id bigint, score double, depth double"), k).select("depth").collect()
    deep = np.sort([r.depth for r in depths]) if depths else np.ones(1)
    return min(1.0, max(LEAST_SHARE, float(deep[min(len(deep) - 1, math.ceil(RECALL * len(deep)))]) + 1 / n))
