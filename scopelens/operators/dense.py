"""Exact dense retrieval: blocks of queries against shards of the corpus, one matrix product per cell.

Lists of the k nearest are held by blocks of queries while the rows of their scope, or all rows, pass by: what is shuffled
afterwards is k rows per query and list, whatever the corpus holds. Pairs above a bound are sought in cells of blocks and shards. Ranks go by the score rounded to 6 places, then by the smaller id, which makes
them independent of the order of additions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a corpus shard and of a query block.
SHARD_ROWS, BLOCK_ROWS = 1 << 16, 1 << 13
#: Hash parts that scopes are dealt into; bytes of a block's queries and rows of its lists; scores made at once; new rows after which lists are cut.
PARTS, BLOCK_BYTES, LISTED, CELL, MOST_NEW = 64, 32 << 20, 1 << 22, 1 << 21, 1 << 18
_SCHEMA = "qid bigint, list string, id bigint, sim double"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix of doubles."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


def _cell(least: float):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        qs, ls, ids, sims = [], [], [], []
        if len(data) and len(queries):
            x, q = matrix(data.column("v")), matrix(queries.column("v"))
            own, qid, names = data.column("id").to_numpy(), queries.column("qid").to_numpy(), queries.column("list").combine_chunks()
            scope, wanted = data.column("scope").combine_chunks(), queries.column("scope").combine_chunks()
            step = max(1, CELL // len(x))
            for a in range(0, len(q), step):
                block = np.round(q[a : a + step] @ x.T, 6)
                i, j = np.nonzero(block >= least)
                other = own[j] != qid[a + i]
                if wanted.null_count < len(wanted):
                    want = wanted.take(pa.array(a + i))
                    other &= pc.fill_null(pc.or_kleene(pc.is_null(want), pc.equal(want, scope.take(pa.array(j)))), False).to_numpy(zero_copy_only=False)
                i, j = i[other], j[other]
                qs.append(qid[a + i])
                ls.append(names.take(pa.array(a + i)))
                ids.append(own[j])
                sims.append(block[i, j])
        cat = lambda p, kind: np.concatenate(p).astype(kind) if p else np.zeros(0, kind)
        return pa.table({"qid": cat(qs, np.int64), "list": pa.chunked_array(ls, pa.string()), "id": cat(ids, np.int64), "sim": cat(sims, np.float64)})

    return run


def _cells(corpus: DataFrame, queries: DataFrame, run) -> DataFrame:
    """Both sides have their rows counted first; shards follow the size, and small inputs still use several cores."""
    spark = corpus.sparkSession
    n, m = corpus.count(), queries.count()
    shards = max(math.ceil(n / SHARD_ROWS), min(spark.sparkContext.defaultParallelism, max(1, n // 250)))
    blocks = max(1, math.ceil(m / BLOCK_ROWS))
    d = corpus.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return d.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInArrow(run, _SCHEMA)


def _shape(df: DataFrame, key: str) -> DataFrame:
    cols = set(df.columns)
    extra = [F.col("list") if "list" in cols else F.lit("").alias("list")] * (key == "qid")
    return df.select(F.col(key).cast("bigint").alias(key), F.col("v").cast("array<double>").alias("v"), (F.col("scope").cast("string") if "scope" in cols else F.lit(None).cast("string")).alias("scope"), *extra)


def _spread(corpus: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, int] | None:
    """(cell, kind, scope, list, id, v): queries (kind 0), each in one block, and the corpus rows that blocks meet (kind 1).

    Rows and queries of a scope meet in its part, queries without one meet all rows in a part of their own. A block is
    as large as its lists' memory allows, since every block of a part takes a copy of its rows.
    """
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    part = F.pmod(F.xxhash64("scope"), F.lit(PARTS)).cast("int")
    # Vectors of single precision stay so until they are multiplied, as doubles.
    single = F.min(F.forall("v", lambda x: x == x.cast("float").cast("double")))
    about = lambda df, p: {r.part: r for r in df.groupBy(p.alias("part")).agg(F.count("*").alias("n"), single.alias("single"), F.max(F.size("v")).alias("dim")).collect()}
    asked, held = about(queries, F.when(F.col("scope").isNull(), -1).otherwise(part)), about(corpus, F.coalesce(part, F.lit(-2)))
    rows = {p: sum(r.n for r in held.values()) if p < 0 else held[p].n for p in asked if p < 0 or p in held}
    work = sum(asked[p].n * n for p, n in rows.items())
    if not work:
        return None
    kind = "float" if all(r.single is not False for r in (*asked.values(), *held.values())) else "double"
    dim = max(1, *(r.dim or 1 for r in asked.values()))
    plans, base = [], 0
    for p, n in rows.items():
        m = asked[p].n
        want = math.ceil(2 * cores * m * n / work)
        most = max(64, min(BLOCK_BYTES // (8 * dim), LISTED // max(1, min(k, n))))
        blocks = max(math.ceil(m / most), min(want, math.ceil(m / 256)))
        shards = min(math.ceil(want / blocks), math.ceil(n / 1024))
        plans.append((p, base, blocks, shards))
        base += blocks * shards
    of = lambda i: F.create_map(*[F.lit(x) for plan in plans for x in (plan[0], plan[i])])
    first, blocks, shards = (F.try_element_at(of(i), F.col("part")) for i in (1, 2, 3))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    place = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    v = F.col("v").cast(f"array<{kind}>").alias("v")
    q = queries.withColumn("part", F.when(F.col("scope").isNull(), -1).otherwise(part)).where(first.isNotNull())
    q = q.withColumns({"at": first + place("qid", blocks), "blocks": blocks}).withColumn("shard", every(shards))
    q = q.select((F.col("at") + F.col("shard") * F.col("blocks")).alias("cell"), F.lit(0).alias("kind"), "scope", "list", F.col("qid").alias("id"), v)
    d = corpus.withColumn("part", F.explode(F.array(part, F.lit(-1)))).where(first.isNotNull())
    d = d.withColumn("at", first + place("id", shards) * blocks).withColumn("block", every(blocks))
    d = d.select((F.col("at") + F.col("block")).alias("cell"), F.lit(1).alias("kind"), "scope", F.lit(None).cast("string").alias("list"), "id", v)
    return q.unionByName(d), base


class _Nearest:
    """The k nearest of a block's queries among the rows that come by."""

    def __init__(self, asked: pa.Table, k: int, exclude_self: bool, ties: bool):
        scope = asked.column("scope").combine_chunks().dictionary_encode()
        code = pc.fill_null(scope.indices, -1).to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        self.scopes, code = scope.dictionary, code[order]
        asked = asked.take(pa.array(order))
        self.k, self.exclude_self, self.ties = k, exclude_self, ties
        self.q, self.qid, self.list = matrix(asked.column("v")), asked.column("id").to_numpy(), asked.column("list").combine_chunks()
        self.runs = {c: tuple(np.searchsorted(code, [c, c + 1])) for c in np.unique(code).tolist()}
        self.least = np.full(len(code), -np.inf)
        self.kept, self.new, self.size = None, [], 0

    def add(self, b: pa.RecordBatch) -> None:
        x, ids = matrix(b.column("v")), b.column("id").to_numpy()
        scope = pc.fill_null(pc.index_in(b.column("scope"), value_set=self.scopes), -1).to_numpy(zero_copy_only=False) if len(self.scopes) else None
        for c, (lo, hi) in self.runs.items():
            some = slice(None) if c < 0 else np.flatnonzero(scope == c)
            if c < 0 or len(some):
                self._meet(lo, hi, x[some], ids[some])
        if self.size > max(MOST_NEW, self.k * len(self.qid) // 2):
            self.cut()

    def _meet(self, lo: int, hi: int, x: np.ndarray, ids: np.ndarray) -> None:
        n, flipped = len(x), x.T
        step = max(1, CELL // n)
        for a in range(lo, hi, step):
            b = min(a + step, hi)
            s = self.q[a:b] @ flipped
            if self.exclude_self:
                order = np.argsort(self.qid[a:b], kind="stable")
                own = self.qid[a:b][order]
                first, last = np.searchsorted(own, ids), np.searchsorted(own, ids, side="right")
                for j in np.flatnonzero(last > first).tolist():
                    s[order[first[j] : last[j]], j] = -np.inf
            least = self.least[a:b]
            if n > self.k:
                fresh = np.flatnonzero(np.isneginf(least))
                if len(fresh):
                    least[fresh] = np.round(np.partition(s[fresh], n - self.k, axis=1)[:, n - self.k], 6)
            # Only what may round up to the k-th best is rounded.
            i, j = np.nonzero(s >= (least - 1e-6)[:, None])
            sim = np.round(s[i, j], 6)
            good = (sim >= least[i]) & (sim > -np.inf)
            self.new.append((i[good] + a, ids[j[good]], sim[good]))
            self.size += int(good.sum())

    def cut(self) -> None:
        parts = self.new if self.kept is None else [self.kept, *self.new]
        if not parts:
            return
        i, ids, sim = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((ids, -sim, i))
        i, ids, sim = i[order], ids[order], sim[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        last = rank == self.k - 1
        self.least[i[last]] = sim[last]
        keep = sim >= self.least[i] if self.ties else rank < self.k
        self.kept, self.new, self.size = (i[keep], ids[keep], sim[keep]), [], 0

    def result(self) -> Iterator[pa.RecordBatch]:
        self.cut()
        if self.kept is not None:
            i, ids, sim = self.kept
            at = pa.array(i)
            yield from pa.table({"qid": pa.array(self.qid).take(at), "list": self.list.take(at), "id": pa.array(ids), "sim": pa.array(sim)}).to_batches(max_chunksize=1 << 16)


def _stream(k: int, exclude_self: bool, ties: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, scan = None, [], None
        for whole in batches:
            kinds = whole.column("cell").to_numpy().astype(np.int64) * 2 + whole.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1], True]) if len(kinds) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                b = whole.slice(lo, hi - lo)
                if kinds[lo] // 2 != cell:
                    if scan is not None:
                        yield from scan.result()
                    cell, asked, scan = kinds[lo] // 2, [], None
                if not kinds[lo] % 2:
                    asked.append(b)
                elif asked:
                    scan = scan or _Nearest(pa.Table.from_batches(asked), k, exclude_self, ties)
                    scan.add(b)
        if scan is not None:
            yield from scan.result()

    return run


def topk(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, ties: bool = False) -> DataFrame:
    """(qid, list, id, sim, rank): queries (qid, v[, scope][, list]), corpus (id, v[, scope]).

    A query with a scope sees only the corpus rows of that scope (pre-filter); one without sees all. With
    ``ties`` all rows as similar as the k-th are in, and equals share a rank.
    """
    spread = _spread(_shape(corpus, "id"), _shape(queries, "qid"), k)
    if spread is None:
        found = corpus.sparkSession.createDataFrame([], _SCHEMA)
    else:
        # A block's queries come before its rows, which pass by in batches.
        met = spread[0].repartition(spread[1], "cell").sortWithinPartitions("cell", "kind")
        found = met.mapInArrow(_stream(k, exclude_self, ties), _SCHEMA)
    if ties:
        return found.withColumn("rank", F.rank().over(Window.partitionBy("qid", "list").orderBy(F.desc("sim")))).where(F.col("rank") <= k)
    w = Window.partitionBy("qid", "list").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar(queries: DataFrame, corpus: DataFrame, least: float) -> DataFrame:
    """(qid, list, id, sim) of all pairs with that similarity at least, without a query's own row."""
    return _cells(_shape(corpus, "id"), _shape(queries, "qid"), _cell(least))


def moments(corpus: DataFrame) -> DataFrame:
    """(n, total, squares) of the similarities of all ordered pairs of different rows.

    No pair is made: over all pairs similarities add up to the square of the sum vector, their squares to the squares of
    the matrix of summed products, both of which batches give. What pairs of one id add to these is taken off.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, dim = 0, 0
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"))
                if not dim:
                    dim = x.shape[1]
                    first, second = np.zeros(dim), np.zeros((dim, dim))
                n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
        if n:
            flat = np.concatenate([[n], first, second.ravel()])
            yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(len(flat)), pa.int32()), "x": pa.array(flat)})

    rows = corpus.where("v IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    # 1 + d + d * d numbers for vectors of length d, whatever their count.
    added = rows.select("v").mapInArrow(sums, "pos int, x double").groupBy("pos").agg(F.sum("x").alias("x"))
    d = F.floor((F.sqrt(4 * F.max("pos") + 1) - 1) / 2).cast("int")
    every = added.agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("a"), d.alias("d")).select(F.col("a.x").alias("a"), "d")
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    every = every.select(F.get("a", F.lit(0)).alias("m"), square(F.slice("a", 2, F.col("d"))).alias("t"), square(F.slice("a", F.col("d") + 2, F.col("d") * F.col("d"))).alias("q"))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sums_of = lambda df, sign: df.agg((sign * F.count("*")).alias("n"), (sign * F.coalesce(F.sum("s"), F.lit(0.0))).alias("t"), (sign * F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0))).alias("q"))
    own = lambda df: df.select(dot(F.col("v"), F.col("v")).alias("s"))
    # Rows whose id occurs more than once meet all rows of it, themselves included, in place of themselves alone.
    twice = rows.join(rows.groupBy("id").count().where("count > 1").select("id"), "id", "left_semi")
    pairs = twice.withColumnRenamed("v", "u").join(twice, "id").select(dot(F.col("u"), F.col("v")).alias("s"))
    parts = sums_of(own(rows), 1).unionByName(sums_of(own(twice), -1)).unionByName(sums_of(pairs, 1))
    less = parts.agg(*[F.sum(c).alias(f"less_{c}") for c in ("n", "t", "q")])
    m = every.crossJoin(less)
    return m.select((F.col("m") * F.col("m") - F.col("less_n")).alias("n"), (F.col("t") - F.col("less_t")).alias("total"), (F.col("q") - F.col("less_q")).alias("squares"))
