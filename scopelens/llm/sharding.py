"""Sharding: contiguous shards of near-equal bytes, cut from a global prefix sum of sizes.

Only keys and sizes move: rows are range-partitioned by a 128-bit fingerprint of the text and the id, every
partition reports its totals, the driver adds up those few rows, and each partition then knows the global
byte offset of all its rows. A shard is the stretch between two equal byte targets of that order.

Equal texts are neighbours in the order. A group of equal texts goes where its middle falls, so that it stays in
one shard, if it has up to ``spread`` of a shard's target. Keeping a group of size g whole can move a cut, and
with it the sizes of two shards, by g / 2; so a group above the spread that sizes may have cannot be kept whole
for sure, and every such group, however large, is cut by its rows.

Rows of equal text and id are counted before they are shuffled and travel as runs of up to ``RUN`` rows, so
copies without ids load no partition.

Defined cases: a null text counts as an empty one of size 1; null ids sort first; repeated rows each take
their own slot; an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, shuffle_partitions, tune

#: Rows of equal text and id that travel as one.
RUN = 100_000
#: Rows that a range is meant to hold; a task has its range's keys in memory.
RANGE_ROWS = 1_000_000
_KEYS = "doc_id bigint, size bigint, text_crc32 bigint, ha bigint, hb bigint"


def _runs(b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ha, hb = b.column("ha").to_numpy(), b.column("hb").to_numpy()
    first = np.flatnonzero(np.r_[True, (ha[1:] != ha[:-1]) | (hb[1:] != hb[:-1])])
    return first, np.diff(np.r_[first, len(ha)])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the partition: rows, bytes, and bytes of its first and last group of equal texts."""
    got = list(batches)
    if sum(b.num_rows for b in got):
        t = pa.Table.from_batches(got)
        m = t.column("m").to_numpy()
        size = t.column("size").to_numpy() * m
        first, n = _runs(t)
        sums = np.add.reduceat(size, first)
        ends = [int(t.column(c)[i].as_py()) for i in (0, len(size) - 1) for c in ("ha", "hb")]
        row = [TaskContext.get().partitionId(), int(m.sum()), int(size.sum()), len(first), int(sums[0]), int(sums[-1]), *ends]
        yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in zip(("pid", "n", "bytes", "runs", "head", "tail", "fa", "fb", "la", "lb"), row, strict=True)})


def _offsets(parts: list) -> tuple[dict[int, tuple[int, int, int, int, int, int]], int]:
    """By partition: rows and bytes before it; start and total of its first group, start and total of its last."""
    parts = sorted(parts, key=lambda r: r.pid)
    starts, runs = [], []  # runs: [key, start, total] of groups that touch an edge of a partition
    rows = total = 0
    where: dict[int, list] = {}
    for r in parts:
        starts.append((r.pid, rows, total))
        head, tail = (r.fa, r.fb), (r.la, r.lb)
        if not runs or runs[-1][0] != head:
            runs.append([head, total, 0])
        runs[-1][2] += r.head
        mine = [runs[-1]]
        if r.runs > 1:
            runs.append([tail, total + r.bytes - r.tail, r.tail])
        where[r.pid] = [mine[0], runs[-1]]
        rows, total = rows + r.n, total + r.bytes
    return {pid: (n, b, where[pid][0][1], where[pid][0][2], where[pid][1][1], where[pid][1][2]) for pid, n, b in starts}, total


def _hash_a(text: Column) -> Column:
    return F.xxhash64(text)


def _hash_b(text: Column) -> Column:
    return F.xxhash64(F.lit(0x5EED), text, F.octet_length(text))


def assign_shards(docs: DataFrame, shards: int = 8, spread: float = 0.125, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, under the law ``bytes``, and ``ha`` and ``hb``, the text's fingerprint."""
    spark = docs.sparkSession
    tune(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _hash_a(text).alias("ha"),
        _hash_b(text).alias("hb"),
    )
    # One row for each run of equal rows.
    counted = keys.groupBy(*keys.columns).agg(F.count("*").alias("all"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("all") - 1) / RUN))))
    keys = runs.select(*keys.columns, "run", F.least(F.col("all") - F.col("run") * RUN, F.lit(RUN)).alias("m"))
    order = ["ha", "hb", "doc_id", "run"]
    ranges = max(shuffle_partitions(spark), docs.count() // RANGE_ROWS)
    keys = cut(keys.repartitionByRange(ranges, *order).sortWithinPartitions(*order))
    parts = keys.mapInArrow(_totals, "pid bigint, n bigint, bytes bigint, runs bigint, head bigint, tail bigint, fa bigint, fb bigint, la bigint, lb bigint").collect()
    at, total = _offsets(parts)
    target = total / shards if total else 1.0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got)
        row0, byte0, head_at, head_all, tail_at, tail_all = at[TaskContext.get().partitionId()]
        m = t.column("m").to_numpy()
        first, n = _runs(t)
        size = t.column("size").to_numpy() * m
        begin = byte0 + np.cumsum(size) - size
        start, sums = begin[first], np.add.reduceat(size, first)
        start[0], sums[0], start[-1], sums[-1] = head_at, head_all, tail_at, tail_all
        group_at, group_size = np.repeat(start, n), np.repeat(sums, n)
        rank = row0 + np.cumsum(m) - m
        ends = np.cumsum(m)
        for lo in range(0, len(m), 4096):  # a stretch of runs at a time, row by row
            part = slice(lo, min(lo + 4096, len(m)))
            for a in range(int(ends[lo - 1]) if lo else 0, int(ends[part.stop - 1]), RUN):
                row = np.arange(a, min(a + RUN, int(ends[part.stop - 1])))
                of = np.searchsorted(ends, row, "right")
                within = row - (ends[of] - m[of])
                one = size[of] // m[of]
                middle = np.where(group_size[of] <= spread * target, group_at[of] + group_size[of] / 2, begin[of] + within * one + one / 2)
                shard = np.minimum(middle // target, shards - 1).astype(np.int32)
                take = t.take(pa.array(of))
                yield from (
                    pa.table({"doc_id": take.column("doc_id"), "size": take.column("size"), "text_crc32": take.column("text_crc32"), "shard": pa.array(shard), "rank": pa.array(rank[of] + within), "ha": take.column("ha"), "hb": take.column("hb")})
                    .combine_chunks()
                    .to_batches()
                )

    placed = keys.mapInArrow(place, "doc_id bigint, size bigint, text_crc32 bigint, shard int, rank bigint, ha bigint, hb bigint")
    lowest = {r.shard: r.low for r in placed.groupBy("shard").agg(F.min("rank").alias("low")).collect()}
    base = F.element_at(F.create_map(*[F.lit(x) for kv in lowest.items() for x in kv]), F.col("shard")) if lowest else F.lit(0)
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - base).cast("bigint").alias("slot"), "ha", "hb")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows themselves as one folder per shard, in slot order inside each file; a column ``shard`` is replaced.

    Rows meet their places by id and text, those that share both in any order.
    """
    ha, hb, id_, no, shard, slot = (free(docs, c) for c in ("ha", "hb", "id", "no", "shard", "slot"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({ha: _hash_a(text), hb: _hash_b(text), id_: F.col(id_col).cast("bigint")})
    placed = assign_shards(docs, shards, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(id_), F.col("ha").alias(ha), F.col("hb").alias(hb), F.col("shard").alias(shard), F.col("slot").alias(slot))
    names = [ha, hb, id_]
    # A row that is alone under its id and text needs no number; the others are numbered on both sides.
    alone = cut(placed.groupBy(*names).agg(F.count("*").alias(no)).where(F.col(no) > 1).drop(no))
    same = lambda x, y: (x[ha] == y[ha]) & (x[hb] == y[hb]) & x[id_].eqNullSafe(y[id_])
    passed = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"]
    out = keyed.join(placed.join(alone, same(placed, alone), "left_anti").withColumnsRenamed({c: f"{c}_" for c in names}), F.expr(f"{ha} = {ha}_ AND {hb} = {hb}_ AND {id_} <=> {id_}_"))
    out = out.select(*passed, shard, slot)
    if not alone.isEmpty():
        numbered = lambda x, by: x.join(alone, same(x, alone), "left_semi").withColumn(no, F.row_number().over(Window.partitionBy(*names).orderBy(by)))
        more = numbered(placed, slot).withColumnsRenamed({c: f"{c}_" for c in [*names, no]})
        out = out.union(numbered(keyed, F.lit(0)).join(more, F.expr(f"{ha} = {ha}_ AND {hb} = {hb}_ AND {id_} <=> {id_}_ AND {no} = {no}_")).select(*passed, shard, slot))
    out = out.withColumnRenamed(shard, "shard")
    out.repartitionByRange(shards * 4, "shard", slot).sortWithinPartitions("shard", slot).drop(slot).write.mode("overwrite").partitionBy("shard").parquet(path)
