"""What several training-data operators share: checkpoints, byte-level word arrays, packed blobs, components.

Word arrays are numpy views over the UTF-8 buffers that Arrow hands to a Python worker, so no text is
decoded and no Python object is made per word.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Freed Arrow buffers go back to the system, so a worker that has seen one large partition doesn't keep its size.
pa.set_memory_pool(pa.system_memory_pool())

#: Text bytes that one vectorised step looks at; bounds a worker's memory whatever the batch holds. Steps that
#: send blobs take more, so that blobs don't get small.
STEP_BYTES, SEND_BYTES = 1 << 20, 3 << 20
U64 = np.uint64
_RNG = np.random.default_rng(20240229)
#: Random 64-bit values of the 256 bytes, and the base of the polynomial hash over them.
_BYTE = _RNG.integers(0, 2**64, size=256, dtype=U64)
_MULT = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that very long texts can't make a batch of gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a checkpoint file of ids and numbers.
FILE_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for all executors; only a local master, as in tests, may do with a temporary one."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="scopelens-")


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` computed once and kept in the folder that all executors share; its lineage ends there.

    A table that is known to have about ``rows`` short rows is written as few files.
    """
    sc = df.sparkSession.sparkContext
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def by_partition(df: DataFrame, n: int, target: str) -> DataFrame:
    """Row r goes to partition r[target] of n; the ids are already balanced, so no second hash blurs them."""
    return df.repartitionById(n, F.col(target))


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't use."""
    used = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in used:
        pass
    return name


def text_key(column: str = "text") -> Column:
    """With the id, it names a row: repeated rows share it, other texts under the same id don't."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")), F.col(column).isNull())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


@lru_cache(1)
def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Hands freed memory back to the system, so that workers that wait for other tasks don't keep a partition's size."""
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def steps(batches: Iterator[pa.RecordBatch], text: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``size`` bytes of text each (or one row)."""
    for b in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0)).astype(np.int64)
        start, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > size:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)
    trim()


class _Powers:
    """Powers of an odd number modulo 2^64 as products of two small tables, so no table is as long as a text."""

    LOW = 1 << 12

    def __init__(self, base: int):
        self.base = base
        self.low = self._table(base, self.LOW)
        self.high = self._table(pow(base, self.LOW, 1 << 64), 1 << 10)

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        p = np.full(size, base, U64)
        p[0] = 1
        return np.cumprod(p, dtype=U64)

    def _reach(self, n: int) -> None:
        while n > len(self.high) * self.LOW:
            self.high = self._table(pow(self.base, self.LOW, 1 << 64), 2 * len(self.high))

    def at(self, i: np.ndarray) -> np.ndarray:
        self._reach(int(i.max(initial=0)) + 1)
        return self.low[i & (self.LOW - 1)] * self.high[i >> 12]

    def upto(self, n: int) -> np.ndarray:
        self._reach(n)
        return (self.high[: -(-n // self.LOW), None] * self.low).reshape(-1)[:n]


@lru_cache(16)
def _powers(multiplier: int) -> tuple[_Powers, _Powers]:
    """Powers of an odd number, and of its inverse."""
    return _Powers(multiplier), _Powers(pow(multiplier, -1, 1 << 64))


def _sums(values: np.ndarray, multiplier: int) -> np.ndarray:
    """Prefix sums of values[i] * m^i, with one more entry, 0, in front.

    (sums[e] - sums[s]) * m^-s is the polynomial hash of values[s:e], wherever they are.
    """
    out = np.zeros(len(values) + 1, U64)
    np.multiply(values, _powers(multiplier)[0].upto(len(values)), out=out[1:])
    return np.cumsum(out, out=out)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts, as arrays over their bytes.

    ``start``/``end``: byte bounds; ``doc``: index of the text; ``first``: index of each text's first word
    (one more entry at the end). A null text has no words. ``breaks`` are the bytes between words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, breaks: np.ndarray = _SPACE):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
        self.bytes = _LOWER[raw] if lower else raw
        self.bounds = off - off[0]
        self._word = word = ~breaks[raw]
        inner = self.bounds[(self.bounds > 0) & (self.bounds < len(raw))]
        edge = np.zeros(len(raw), bool)
        edge[1:] = word[:-1]
        edge[inner] = False
        self.start = np.flatnonzero(word & ~edge)
        edge[:-1], edge[-1:] = word[1:], False
        edge[inner - 1] = False
        self.end = np.flatnonzero(word & ~edge) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.first))
        self.length = self.end - self.start

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        sums = _sums(_BYTE[self.bytes], _MULT)
        return mix((sums[self.end] - sums[self.start]) * _powers(_MULT)[1].at(self.start) + self.length.astype(U64))

    def prefix_hashes(self, sizes: tuple[int, ...]) -> list[np.ndarray]:
        """For each size, a hash of each word's first so many code points (of the whole word if it is shorter)."""
        sums = _sums(_BYTE[self.bytes], _MULT)
        shift = _powers(_MULT)[1].at(self.start)
        lead = np.flatnonzero((self.bytes & 0xC0) != 0x80)
        at = np.searchsorted(lead, self.start)
        lead = np.r_[lead, np.full(max(sizes), len(self.bytes))]
        return [mix((sums[np.minimum(self.end, lead[at + n])] - sums[self.start]) * shift + U64(n << 32)) for n in sizes]

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each followed by one space, and where each begins (one more entry at the end)."""
        at = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.length + 1, out=at[1:])
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        out = np.full(at[-1], 0x20, np.uint8)
        out[inside] = self.bytes[self._word]
        return out, at


def rolled(h: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive values of ``h``."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    sums = _sums(h, multiplier)
    return mix((sums[width:] - sums[:n]) * _powers(multiplier)[1].upto(n))


def to_blob(level: int = 1, **columns) -> bytes:
    """Columns of equal length as one Arrow stream, compressed at a zstd level."""
    batch = pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_blob(blob) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def spans(order_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array: their first places and their counts."""
    if not len(order_key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, order_key[1:] != order_key[:-1]])
    return first, np.diff(np.r_[first, len(order_key)])


class Heavy:
    """The keys that may hold more than a set share of all weight, in bounded memory (Misra and Gries 1982).

    Whatever has more than 1 / ``room`` of a task's weight is kept, its weight too low by that share at most. With
    ``room`` = 32 * parts and what ``rows`` gives, every key of at least 1 / (8 * parts) of all tasks' weight is
    found by ``heavy_keys``, however thin it is spread, and at most 32 * parts keys are.
    """

    def __init__(self, parts: int):
        self.parts, self.total = parts, 0
        self.keys, self.weights = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        """keys: int64, distinct or not."""
        self.total += int(weights.sum())
        keys, weights = np.concatenate([self.keys, keys]), np.concatenate([self.weights, weights])
        order = np.argsort(keys, kind="stable")
        first, _ = spans(keys[order])
        if not len(first):
            return
        keys, weights = keys[order][first], np.add.reduceat(weights[order], first)
        if len(keys) > (room := 32 * self.parts):
            weights = weights - np.partition(weights, len(weights) - room - 1)[len(weights) - room - 1]
            keys, weights = keys[weights > 0], weights[weights > 0]
        self.keys, self.weights = keys, weights

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys worth telling, with their weights, and all weight under no key at the end."""
        tell = self.weights * 32 * self.parts >= self.total
        return self.keys[tell], np.r_[self.weights[tell], self.total]


def heavy_keys(told: DataFrame, parts: int, least: int) -> tuple[np.ndarray, int]:
    """The heavy keys among (key, weight) rows of all tasks, sorted, and all weight; lighter ones than ``least`` don't count."""
    sums = cut(told.groupBy("key").agg(F.sum("weight").alias("weight")))
    total = sums.where("key IS NULL").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    rows = sums.where("key IS NOT NULL").where(F.col("weight") >= max(least, total // (32 * parts))).collect()  # at most 32 * parts
    return np.array(sorted(r.key for r in rows), np.int64), total


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as stars: every node but the smallest of its component, and that smallest one."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    low = np.arange(len(nodes))
    while len(nodes):
        x, y = low[u], low[v]
        least, new = np.minimum(x, y), low.copy()
        for at in (u, v, x, y):  # the names themselves hang lower too, so whole trees move at once
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    hangs = low != np.arange(len(nodes))
    return nodes[hangs], nodes[low[hangs]]


#: Links that a task collects before it reduces them to stars; links of a node from which on it is a hub.
FOREST_LINKS, HUB = 1 << 21, 200


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as stars, of which there are fewer than nodes."""
    a = b = np.zeros(0, np.int64)
    parts, held = [], 0
    for x in batches:
        parts.append((x.column("a").to_numpy(), x.column("b").to_numpy()))
        held += x.num_rows
        if held > FOREST_LINKS:
            a, b = forest(np.concatenate([a, *[p[0] for p in parts]]), np.concatenate([b, *[p[1] for p in parts]]))
            parts, held = [], 0
    a, b = forest(np.concatenate([a, *[p[0] for p in parts]]), np.concatenate([b, *[p[1] for p in parts]]))
    yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


def _with_least(links: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """``links`` (a, b) with ``low``, the least of a's neighbours. Links of hubs stay in the tasks where they are.

    There are at most twice as many hubs as links divided by ``limit``, which follows the links and partitions.
    """
    hubs = least.where(F.col("degree") >= limit).select("a", "low")
    if hubs.isEmpty():
        return links.join(least.select("a", "low"), "a")
    hubs = F.broadcast(hubs)
    return links.join(hubs, "a").union(links.join(hubs, "a", "left_anti").join(least.where(F.col("degree") < limit).select("a", "low"), "a"))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b), the component being its smallest node.

    Every task first reduces its links to stars. Then large-star and small-star steps alternate until all links
    are stars of which no centre is a leaf: every step is a grouped minimum and a join of the links with it, so
    no node's neighbours and no component meet in one task, and the number of steps grows with the logarithm of
    the longest chain. The links are written to the shared folder after each step.
    """
    spark = edges.sparkSession
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    e = cut(e.mapInArrow(_forests, "a bigint, b bigint").distinct())
    rows = e.count()  # no step has more than twice as many links
    if not rows:
        return spark.createDataFrame([], "node bigint, component bigint")
    hub = max(HUB, rows // (4 * shuffle_partitions(spark)))

    def least(links: DataFrame) -> DataFrame:
        return cut(links.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("degree")), 2 * rows)

    for _ in range(limit):
        below = least(e)
        stars = below.where("degree > 1").isEmpty() and e.select(F.col("b").alias("a")).distinct().join(below, "a", "left_semi").isEmpty()
        if stars:
            break
        # Large star: the larger neighbours of a node hang from the smallest of it and its neighbours.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both).withColumn("low", F.least("a", "low"))
        e = cut(_with_least(both.where("b > a"), low, hub).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), 2 * rows)
        # Small star: a node and its smaller neighbours hang from the smallest of them.
        near = _with_least(e, least(e), hub)
        e = near.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = cut(e, 2 * rows)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
