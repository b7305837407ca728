"""What the vector operators share: which vectors take part, equal vectors, shards, their indexes, and query blocks.

A shard's index is built once, written to the shared folder, and then meets every block of the queries.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bytes of a shard's vectors and of a block's: a cell of both fits in a worker several times over.
SHARD_BYTES, BLOCK_BYTES = 32 << 20, 16 << 20
#: Shards of a small table: enough to use many cores, no more than one per so many rows.
LEAST_SHARDS, LEAST_ROWS = 12, 800


def usable(v: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def valid(df: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part. -0.0 becomes 0.0, so equal vectors are equal bytes."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    return df.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("embedding")).where(usable(F.col("embedding")))


def distinct_vectors(v: DataFrame, keep: int) -> DataFrame:
    """(embedding, ids): one row per distinct vector with its ``keep`` smallest ids."""
    w = Window.partitionBy("embedding").orderBy("vec_id")
    few = v.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def width_of(data: DataFrame) -> int:
    """The length of the vectors, which all have one."""
    row = data.select(F.size("embedding").alias("n")).first()
    return max(1, row.n) if row else 1


def shard_count(n: int, dim: int) -> int:
    return max(math.ceil(n * dim * 8 / SHARD_BYTES), min(LEAST_SHARDS, max(n // LEAST_ROWS, 1)))


def block_count(n: int, dim: int) -> int:
    return max(1, math.ceil(n * dim * 8 / BLOCK_BYTES))


def _shard(id_col: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int")


def _upto(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _queries(queries: DataFrame, shards: int, blocks: int) -> DataFrame:
    return queries.withColumn("block", _shard("query_id", blocks)).withColumn("shard", _upto(shards))


def cells(data: DataFrame, queries: DataFrame, id_col: str, shards: int, blocks: int):
    """Cogrouped (data, queries): every shard of the data meets every block of the queries."""
    d = data.withColumn("shard", _shard(id_col, shards)).withColumn("block", _upto(blocks))
    return d.groupBy("shard", "block").cogroup(_queries(queries, shards, blocks).groupBy("shard", "block"))


def indexes(data: DataFrame, id_col: str, shards: int, build: Callable[[pa.Table], dict[str, np.ndarray]]) -> DataFrame:
    """(shard, index): what ``build`` makes of every shard of the data, in the shared folder."""

    def run(t: pa.Table) -> pa.Table:
        kept = io.BytesIO()
        np.savez(kept, **build(t))
        return pa.table({"shard": t.column("shard").slice(0, 1), "index": pa.array([kept.getvalue()], pa.binary())})

    return cut(data.withColumn("shard", _shard(id_col, shards)).groupBy("shard").applyInArrow(run, "shard int, index binary"))


def meet(indexed: DataFrame, queries: DataFrame, shards: int, blocks: int):
    """Cogrouped (index, queries): the index of every shard meets every block of the queries."""
    d = indexed.withColumn("block", _upto(blocks))
    return d.groupBy("shard", "block").cogroup(_queries(queries, shards, blocks).groupBy("shard", "block"))


def unpacked(t: pa.Table) -> dict[str, np.ndarray]:
    """The arrays of a cell's index."""
    with np.load(io.BytesIO(t.column("index")[0].as_buffer())) as arrays:
        return dict(arrays)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column whose lists have one length as a float64 matrix."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
