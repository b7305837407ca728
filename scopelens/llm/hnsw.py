"""Embedding near-dedup: hierarchical navigable small-world graphs per shard.

Equal vectors are collapsed first. The distinct ones, named by a hash, fall into shards; each shard gets its
own graph (Malkov and Yashunin 2016), built once and written to the shared folder, and every vector queries
the graph of every shard. Inserts and queries run in batches whose beams advance together as arrays. The beam
width is audited: a sample of vectors is compared with all others, the sample growing until ``LEAST_LINKED`` of
them link with another one, and the width doubles until the mean share of a linked vector's links that is
found, its match with itself left out, reaches ``RECALL``; so a large group weighs no more than pairs. A sample
of ``MOST_AUDITED`` without any link takes the largest width; where no width passes, cells compare all pairs.
A query whose beam holds nothing but links lies in a large group: it meets all vectors of the shard in one
exact product instead, so groups of any size are seen whole. Pairs are verified by cosine in double precision.

No cell lists its pairs: it reduces them to stars, of which there are fewer than vectors, and the stars'
components are found by star steps. All links of a vector lie in its component. They are counted there exactly,
blocks of a component against each other, small components together; so counts are symmetric, and include
links within a component that no beam has found.

Vectors that are null, zero, or hold null or non-finite components link with nothing. All others must have
one length. Every row of the input gives one of the output, whatever ids repeat; a row links with every other
row of a linked vector, of its own id too. Empty tables give empty results; other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, forest, tune
from .vectors import block_count, cells, indexes, matrix, meet, shard_count, unpacked, usable, valid, width_of

#: Links of a node above the ground level, twice as many on it; beam width of inserts; rows of a batch.
M, BUILD_BEAM, BATCH = 12, 32, 1024
AUDIT, RECALL, BEAM = 400, 0.99, 16
#: The sample grows until so many of its vectors link with another, or to so many vectors; rows of an exact product.
LEAST_LINKED, MOST_AUDITED, EXACT_ROWS = 100, 64 * AUDIT, 256
#: Vectors of small components that are counted together; bytes of a block of a large one; pairs held at once.
CLASS_ROWS, CLASS_BYTES, HELD_PAIRS = 2048, 16 << 20, 1 << 22


class Graph:
    """A navigable small-world graph over unit vectors, built and searched in batches."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = x.astype(np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum(-np.log(1 - rng.random(n)) / math.log(M), 8).astype(int)
        self.order = np.argsort(-level, kind="stable")  # the highest nodes come first, so all levels grow together
        self.height = level[self.order]
        self.x = self.x[self.order]
        self.links = []
        for lv in range(int(level.max(initial=0)) + 1):
            size = int((self.height >= lv).sum())
            self.links.append(self._level(size, 2 * M if lv == 0 else M))

    def packed(self) -> dict[str, np.ndarray]:
        return {"order": self.order, **{f"links{i}": x for i, x in enumerate(self.links)}}

    @classmethod
    def of(cls, x: np.ndarray, arrays: dict[str, np.ndarray]) -> Graph:
        """The graph over ``x`` that was packed."""
        g = cls.__new__(cls)
        g.order = arrays["order"]
        g.x = x[g.order].astype(np.float32)
        g.links = [arrays[f"links{i}"] for i in range(sum(k.startswith("links") for k in arrays))]
        return g

    def _level(self, n: int, width: int) -> np.ndarray:
        """Links of the first n nodes, by inserting batches that double up to BATCH."""
        links = np.full((n, width), -1, np.int32)
        near = np.full((n, width), -2, np.float32)
        done = 0
        while done < n:
            size = min(n - done, max(64, min(done, BATCH)))
            new = np.arange(done, done + size)
            inner = self.x[new] @ self.x[new].T
            np.fill_diagonal(inner, -2)
            keep = min(BUILD_BEAM, size)
            top = np.argpartition(-inner, keep - 1, axis=1)[:, :keep]
            ids, sims = new[top], np.take_along_axis(inner, top, 1)
            if done:
                a, b = self._beam(self.x[new], links[:done], np.zeros((size, 1), np.int64), BUILD_BEAM)
                ids, sims = np.concatenate([ids, a], 1), np.concatenate([sims, b], 1)
            ids, sims = self._diverse(self.x[new], ids, sims, width // 2)
            links[new, : ids.shape[1]], near[new, : ids.shape[1]] = ids, sims
            self._back(links, near, new, ids, sims)
            done += size
        return links

    def _diverse(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's candidates, nearest first, those nearer to the query than to any one kept before."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * BUILD_BEAM]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x[np.maximum(ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, bool)
        closest = np.full(ids.shape, -2, np.float32)
        for j in range(ids.shape[1]):
            ok = (ids[:, j] >= 0) & (sims[:, j] > -2) & (taken.sum(1) < most) & (closest[:, j] < sims[:, j])
            taken[:, j] = ok
            closest = np.where(ok[:, None], np.maximum(closest, between[:, j]), closest)
        # Free places go to the nearest of the others.
        rank = np.where(taken, 0, 1) * 1000 + np.arange(ids.shape[1])
        rank = np.argsort(np.where((ids >= 0) & (sims > -2), rank, 10**6), axis=1, kind="stable")[:, :most]
        ids, sims = np.take_along_axis(ids, rank, 1), np.take_along_axis(sims, rank, 1)
        return np.where(sims > -2, ids, -1), sims

    def _back(self, links: np.ndarray, near: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Links in the other direction; a full node keeps a diverse choice of old and new ones."""
        src, dst, s = np.repeat(new, ids.shape[1]), ids.reshape(-1), sims.reshape(-1)
        ok = dst >= 0
        src, dst, s = src[ok], dst[ok], s[ok]
        if not len(dst):
            return
        order = np.lexsort((-s, dst))
        src, dst, s = src[order], dst[order], s[order]
        first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        place = np.arange(len(dst)) - np.repeat(first, np.diff(np.r_[first, len(dst)]))
        fits = place < links.shape[1]
        nodes = dst[first]
        extra = np.full((len(nodes), links.shape[1]), -1, np.int32)
        extra_s = np.full(extra.shape, -2, np.float32)
        row = np.searchsorted(nodes, dst[fits])
        extra[row, place[fits]], extra_s[row, place[fits]] = src[fits], s[fits]
        for a in range(0, len(nodes), BATCH):
            at = nodes[a : a + BATCH]
            both = np.concatenate([links[at], extra[a : a + BATCH]], 1)
            both_s = np.concatenate([near[at], extra_s[a : a + BATCH]], 1)
            order = np.lexsort((-both_s, both), axis=1)
            both, both_s = np.take_along_axis(both, order, 1), np.take_along_axis(both_s, order, 1)
            both_s[:, 1:][both[:, 1:] == both[:, :-1]] = -2
            links[at], near[at] = self._diverse(self.x[at], both, both_s, links.shape[1])

    def _beam(self, q: np.ndarray, links: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The beams' ids and similarities, best first, for all queries at once; entry: (queries, entry points)."""
        n, size = len(links), len(q)
        rows = np.arange(size)
        seen = np.zeros((size, n), bool)
        ids = np.full((size, width), -1, np.int64)
        sims = np.full((size, width), -2, np.float32)
        open_ = np.zeros((size, width), bool)
        e = entry[:, :width]
        ids[:, : e.shape[1]], sims[:, : e.shape[1]], open_[:, : e.shape[1]] = e, np.einsum("qd,qed->qe", q, self.x[e]), True
        seen[rows[:, None], e] = True
        live = rows
        while len(live):
            o = open_[live]
            live = live[o.any(1)]
            if not len(live):
                break
            best = np.where(open_[live], sims[live], -3).argmax(1)
            open_[live, best] = False
            near = links[ids[live, best]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            near = np.where(fresh, near, 0)
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            s = np.full(near.shape, -2, np.float32)
            s[r, c] = np.einsum("nd,nd->n", q[live[r]], self.x[near[r, c]])
            all_s = np.concatenate([sims[live], s], 1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            sims[live] = np.take_along_axis(all_s, top, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], 1), top, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], 1), top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the given vectors (-1: none) and similarities of each query's beam, best first."""
        q = q.astype(np.float32)
        width = min(width, len(self.x))
        step = max(16, min(BATCH, (32 << 20) // max(len(self.x), 1)))
        ids, sims = [], []
        for a in range(0, len(q), step):
            part = q[a : a + step]
            entry = np.zeros((len(part), 1), np.int64)
            for links in self.links[:0:-1]:
                entry = self._beam(part, links, entry, 1)[0]
            i, s = self._beam(part, self.links[0], entry, width)
            ids.append(np.where(i >= 0, self.order[np.maximum(i, 0)], -1))
            sims.append(s)
        return np.concatenate(ids), np.concatenate(sims)


def _linked(x: np.ndarray, q: np.ndarray, row: np.ndarray, col: np.ndarray, least: float) -> np.ndarray:
    """Which pairs have that cosine in double precision; x and q are unit vectors."""
    out = np.zeros(len(row), bool)
    for a in range(0, len(row), 1 << 16):
        out[a : a + (1 << 16)] = (q[row[a : a + (1 << 16)]] * x[col[a : a + (1 << 16)]]).sum(axis=1) >= least
    return out


def _beams(graph: Graph, x: np.ndarray, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector) pairs that link, and the queries whose beam held nothing but links, which aren't among them."""
    ids, sims = graph.search(q, width)
    full = (sims[:, -1] >= least - 1e-4) & (ids.shape[1] < len(x))
    r, c = np.nonzero((sims >= least - 1e-4) & (ids >= 0) & ~full[:, None])
    c = ids[r, c]
    ok = _linked(x, q, r, c, least)
    return r[ok], c[ok], np.flatnonzero(full)


def _mask(x: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Which queries link with which vectors; products too near the threshold for their rounding are summed again in one order."""
    product = q @ x.T
    linked = product >= least
    r, c = np.nonzero(np.abs(product - least) <= 1e-9)
    linked[r, c] = _linked(x, q, r, c, least)
    return linked


def _strip(x: np.ndarray) -> int:
    """Queries whose products with all of ``x`` are held at once."""
    return max(16, min(EXACT_ROWS, HELD_PAIRS // max(len(x), 1)))


def _groups(x: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As much of all links between ``q`` and ``x`` as joins what they join: (query, vector) pairs and (vector, vector) pairs.

    Least labels pass between queries and vectors until they rest, so pairs are never listed.
    """
    rows, cols, a, b = ([] for _ in range(4))
    step = _strip(x)
    for i in range(0, len(q), step):
        linked = _mask(x, q[i : i + step], least)
        own = np.arange(len(x), dtype=np.int32)
        while True:
            of_query = np.where(linked, own, np.int32(len(x))).min(axis=1)
            new = np.minimum(own, np.where(linked, of_query[:, None], np.int32(len(x))).min(axis=0))
            if (new == own).all():
                break
            own = new
        some = np.flatnonzero(of_query < len(x))
        rows.append(some + i)
        cols.append(of_query[some])
        moved = np.flatnonzero(own != np.arange(len(x)))
        a.append(moved)
        b.append(own[moved])
    cat = lambda p: np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64)
    return cat(rows), cat(cols), cat(a), cat(b)


def _unit(t: pa.Table) -> np.ndarray:
    x = matrix(t.column("embedding"))
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither tiny nor huge components overflow a square
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _build(t: pa.Table) -> dict[str, np.ndarray]:
    x = _unit(t)
    return {"x": x, "ids": t.column("node").to_numpy(), **Graph(x).packed()}


def _exact_counts(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, least: float) -> np.ndarray:
    """How many of ``x`` each query links with, itself left out."""
    out, step = np.zeros(len(q), np.int64), _strip(x)
    for i in range(0, len(q), step):
        linked = _mask(x, q[i : i + step], least)
        out[i : i + step] = linked.sum(axis=1) - (linked & (ids == qids[i : i + step, None])).sum(axis=1)
    return out


def _truth(least: float):
    """Exact links of each query to other vectors."""

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out = np.zeros(len(queries), np.int64)
        if len(data) and len(queries):
            out = _exact_counts(_unit(data), data.column("node").to_numpy(), _unit(queries), queries.column("query_id").to_numpy(), least)
        return pa.table({"query_id": queries.column("query_id"), "links": pa.array(out)})

    return run


def _audit(least: float, widths: list[int]):
    """Links of each query to other vectors that beams of each width find."""

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "width": [], "found": []}
        if len(data) and len(queries):
            arrays, q = unpacked(data), _unit(queries)
            x, ids, qids = arrays["x"], arrays["ids"], queries.column("query_id").to_numpy()
            graph = Graph.of(x, arrays)
            for w in widths:
                r, c, full = _beams(graph, x, q, least, w)
                n = np.bincount(r[qids[r] != ids[c]], minlength=len(q))
                n[full] = _exact_counts(x, ids, q[full], qids[full], least)
                out["query_id"] += qids.tolist()
                out["width"] += [w] * len(q)
                out["found"] += n.tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def mean_recall(found: DataFrame, truth: DataFrame) -> dict[int, float]:
    """By width, the mean share of its links that a query finds; found: (query_id, width, found), by shard."""
    per = found.groupBy("query_id", "width").agg(F.sum("found").alias("found")).join(truth, "query_id").where("links > 0")
    return {r.width: r.recall for r in per.groupBy("width").agg(F.avg(F.col("found") / F.col("links")).alias("recall")).collect()}


def audited_width(data: DataFrame, graphs: DataFrame, queries: DataFrame, n: int, shards: int, least: float) -> int:
    """The least beam width with a mean recall of RECALL over queries that link with another vector; 0: none has it."""
    widths, size = [BEAM << i for i in range(5)], AUDIT
    while True:
        sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(size)
        exact = cells(data, sample, "node", shards, 1).applyInArrow(_truth(least), "query_id bigint, links bigint")
        truth = cut(exact.groupBy("query_id").agg(F.sum("links").alias("links")).where("links > 0"))
        if size >= min(n, MOST_AUDITED) or truth.count() >= LEAST_LINKED:
            break
        size *= 4
    few = cut(truth.orderBy(F.xxhash64("query_id"), "query_id").limit(AUDIT))
    linked = cut(queries.join(few.select("query_id"), "query_id", "left_semi"))
    recall = mean_recall(meet(graphs, linked, shards, 1).applyInArrow(_audit(least, widths), "query_id bigint, width bigint, found bigint"), few)
    if not recall and size >= n:
        return widths[0]  # every vector was compared with all others, and no two link
    return next((w for w in widths if recall.get(w, 0.0) >= RECALL), 0 if recall else widths[-1])


_NO_LINKS = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def _stars(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, least: float, beams) -> pa.Table:
    """A cell's links as stars. ``beams`` finds those of a stretch of queries but for some, which meet all vectors."""
    a = b = np.zeros(0, np.int64)
    size = max(16, min(BATCH, HELD_PAIRS // len(x)))
    for i in range(0, len(q), size):
        r, c, full = beams(q[i : i + size])
        gr, gc, ga, gb = _groups(x, q[i : i + size][full], least)
        own = qids[i : i + size]
        a, b = forest(np.concatenate([a, own[r], own[full][gr], ids[ga]]), np.concatenate([b, ids[c], ids[gc], ids[gb]]))
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _links(least: float, width: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(data) or not len(queries):
            return _NO_LINKS
        arrays = unpacked(data)
        x = arrays["x"]
        graph = Graph.of(x, arrays)
        return _stars(x, arrays["ids"], _unit(queries), queries.column("query_id").to_numpy(), least, lambda q: _beams(graph, x, q, least, width))

    return run


def _all_links(least: float):
    """Where no audited beam is wide enough: all pairs of a cell are compared."""
    none = np.zeros(0, np.int64)

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(data) or not len(queries):
            return _NO_LINKS
        return _stars(_unit(data), data.column("node").to_numpy(), _unit(queries), queries.column("query_id").to_numpy(), least, lambda q: (none, none, np.arange(len(q))))

    return run


def _degrees(least: float):
    """Rows that link with each query of a cell, its own copies included; components do not mix."""

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out = np.zeros(len(queries), np.int64)
        if len(data) and len(queries):
            x, q = _unit(data), _unit(queries)
            comp, qcomp, copies = data.column("component").to_numpy(), queries.column("component").to_numpy(), data.column("copies").to_numpy()
            step = _strip(x)
            for a in range(0, len(q), step):
                linked = _mask(x, q[a : a + step], least) & (qcomp[a : a + step, None] == comp)
                out[a : a + step] = linked @ copies
        return pa.table({"node": queries.column("query_id"), "n": pa.array(out)})

    return run


def _counts(members: DataFrame, least: float, dim: int) -> DataFrame:
    """(node, n): rows that link with each vector, itself and its copies included; members: (node, component, embedding, copies).

    A vector is sent once for each block of its component, and a block is as large as a task can well hold.
    """
    rows = max(CLASS_ROWS, CLASS_BYTES // (8 * dim))
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    total = sizes.where(F.col("size") <= CLASS_ROWS).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # Small components share a home; a large one is cut into blocks, all of which meet.
    small = F.col("size") <= CLASS_ROWS
    home = F.when(small, F.pmod(F.xxhash64("component"), F.lit(total // CLASS_ROWS + 1))).otherwise(F.col("component"))
    blocks = F.when(small, 1).otherwise(F.ceil(F.col("size") / rows)).cast("int")
    placed = members.join(sizes, "component").select("node", "component", "embedding", "copies", F.concat_ws("/", small.cast("string"), home).alias("home"), blocks.alias("blocks"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    data = placed.select("node", "component", "embedding", "copies", "home", F.col("own").alias("j"), other.alias("i"))
    fresh = [F.col(c).alias(c) for c in ("component", "embedding", "home")]  # else Spark cannot tell the two sides apart
    queries = placed.select(F.col("node").alias("query_id"), *fresh, F.col("own").alias("i"), other.alias("j"))
    got = data.groupBy("home", "i", "j").cogroup(queries.groupBy("home", "i", "j")).applyInArrow(_degrees(least), "node bigint, n bigint")
    return got.groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    tune(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    good = valid(rows)
    groups = good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("hash", F.xxhash64("embedding"))
    # Vectors that share a hash are told apart by their places among these few.
    place = F.row_number().over(Window.partitionBy("hash").orderBy("embedding"))
    groups = cut(groups.withColumn("place", place).withColumn("node", F.when(F.col("place") == 1, F.col("hash")).otherwise(F.xxhash64("hash", "place"))).drop("hash", "place"))
    data = groups.select("node", "embedding")
    n, dim = groups.count(), width_of(groups)
    shards, blocks = shard_count(n, dim), block_count(n, dim)
    queries = data.withColumnRenamed("node", "query_id")
    graphs = indexes(data, "node", shards, _build)
    width = audited_width(data, graphs, queries, n, shards, least)
    if width:
        found = meet(graphs, queries, shards, blocks).applyInArrow(_links(least, width), "a bigint, b bigint")
    else:
        found = cells(data, queries, "node", shards, blocks).applyInArrow(_all_links(least), "a bigint, b bigint")
    # Written first: no task should hold two Python workers, one that searches and one that reduces links.
    part = cut(components(cut(found)))
    members = cut(groups.join(part, "node"))
    first = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = members.select("node", "component").join(first, "component").select("node", "component_id")
    known = groups.join(named, "node", "left").join(_counts(members, least, dim), "node", "left").select(
        F.col("embedding").alias("_v"),
        (F.coalesce("n", "copies") - 1).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"),
    )
    linked = good.join(known, good["embedding"] == known["_v"]).select("vec_id", "n_links", "component_id")
    # By row, not by id: a usable vector may repeat the id of an unusable one.
    taking_part = F.col("vec_id").isNotNull() & usable(F.col("embedding").cast("array<double>"))
    alone = rows.where(~F.coalesce(taking_part, F.lit(False))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
