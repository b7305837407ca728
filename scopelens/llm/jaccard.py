"""N-gram Jaccard join by multiple-global-order filtering, to connected groups of documents.

A document's set holds its distinct shingles of ``SHINGLE`` words. Two sets link when
100 |A and B| >= 75 |A or B|; then each holds at least ceil(0.75 |X|) of the other's shingles, so whatever the
global order of shingles, the first |X| - ceil(0.75 |X|) + 1 of X (its prefix) hold a common one.

1. Equal sets become one node, named by a 128-bit sum over the set, before anything is compared.
2. Every order used here puts shingles that only one node has first. So a node with more of them than a prefix
   takes can link with nothing; one pass over all shingles, spread by their hash, finds those that nodes share,
   and only nodes that share enough go on, with their shared shingles and how many nodes have each. Shingles so
   frequent that one would load its partition are known from the pass before; they count as shared by all, and
   travel to their nodes' partitions instead.
3. Nodes that agree in the smallest shingle under one of several hash orders stand next to each other in a
   range-partitioned list, and each is verified against a few before it. That joins large groups by chains,
   linear in their size.
4. What these chains may have missed lies between their groups. Nodes post their prefixes under each of
   ``ORDERS`` orders (frequency class, then another hash each). The nodes that post a shingle under the first
   order form a list, those of shingles posted by the same groups one list together; only nodes take part that
   share a posting with another group under every order. The nodes of a list meet in blocks, in which the candidates are the pairs of
   different groups that share prefix shingles under all orders at once and whose sizes and numbers of shared
   shingles allow a link. All of these are verified exactly. Pairs within one group are never listed.

Shingles are compared by 64-bit hashes: two different ones of a pair of sets are taken for equal with a chance
of about their number squared over 2**64, far below what could turn a decision.

Defined cases: texts with fewer words than a shingle have their whole word sequence as their one shingle;
null texts and texts without words have empty sets and link with nothing; a group's name is its smallest id
(null if it has none); repeated rows share a group; an empty table gives an empty result; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SEND_BYTES, U64, Heavy, Words, by_partition, components, cut, free, from_blob, heavy_keys, mix, rolled, shuffle_partitions, spans, steps, text_key, to_blob, trim, tune

SHINGLE = 5
#: Nodes before it that a node is verified against in a list; hash orders of the lists and of the filter.
NEIGHBOURS, LISTS, ORDERS = 8, 2, 3
#: Nodes of a block.
BLOCK = 512
#: Shingles of a partition that gathers them; how many nodes are taken to have a hot shingle.
PART_SHINGLES, EVERYWHERE = 4_000_000, 1 << 30
#: Occurrences below which no shingle is hot.
LEAST_HOT = 1000
#: Names of nodes without any id start here.
NAMELESS = 1 << 62
_ORDER = (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3))


def _need(n):
    """The least number of shingles that a set of n shares with any set it links with."""
    return (3 * n + 3) // 4


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle) of every distinct shingle, sorted, and each text's number of them."""
    w = Words(texts, lower=True)
    h = w.hashes()
    s = rolled(h, SHINGLE, 0x9FB21C651E98DF25)
    ok = w.doc[: len(s)] == w.doc[SHINGLE - 1 :]
    doc, s = w.doc[: len(s)][ok], s[ok]
    count = np.diff(w.first)
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(few):
        total = np.zeros(len(few), U64)
        for k in range(SHINGLE - 1):
            more = count[few] > k
            total[more] = mix(total[more] * U64(3) + h[w.first[few[more]] + k])
        doc, s = np.r_[doc, few.astype(doc.dtype)], np.r_[s, mix(total + count[few].astype(U64))]
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
    doc, s = doc[new], s[new]
    return doc, s, np.bincount(doc, minlength=len(texts))


def _names(doc: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each text's set."""
    out = []
    for c in (_ORDER[2], _ORDER[3]):
        total = np.zeros(len(n), U64)
        first, _ = spans(doc)
        if len(first):
            total[doc[first]] = np.add.reduceat(mix(s ^ c), first)
        out.append(total.view(np.int64))
    return out[0], out[1]


def _nodes(parts: int):
    """Every row's set by name and size; and, under ``key``, the shingles that may be hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, kinds = Heavy(parts), None
        for b in steps(batches, "text"):
            doc, s, n = shingle_sets(b.column("text"))
            heavy.add(s.view(np.int64), np.ones(len(s), np.int64))
            fa, fb = _names(doc, s, n)
            also = {c: b.column(c) for c in b.schema.names if c != "text"}
            none = pa.nulls(b.num_rows, pa.int64())
            kinds = kinds or {c: x.type for c, x in also.items()}
            yield pa.RecordBatch.from_pydict(also | {"fa": pa.array(fa), "fb": pa.array(fb), "n": pa.array(n, pa.int32()), "key": none, "weight": none})
        if kinds:
            keys, weights = heavy.rows()
            none = lambda t: pa.nulls(len(weights), t)
            yield pa.RecordBatch.from_pydict({c: none(t) for c, t in kinds.items()} | {"fa": none(pa.int64()), "fb": none(pa.int64()), "n": none(pa.int32()), "key": pa.array([*keys.tolist(), None], pa.int64()), "weight": pa.array(weights)})

    return run


def _lists(owner: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    """List column of ``values``, which are sorted by ``owner`` (0 to rows - 1)."""
    at = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))


def _blobs(target: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """Rows grouped by target partition, one blob each."""
    order = np.argsort(target, kind="stable")
    t = pa.RecordBatch.from_pydict(columns).take(pa.array(order))
    first, size = spans(target[order])
    out = []
    for s, n in zip(first.tolist(), size.tolist(), strict=True):
        part = t.slice(s, n)
        out.append(to_blob(**{c: part.column(c) for c in part.schema.names}))
    return pa.RecordBatch.from_pydict({"part": pa.array(target[order][first].astype(np.int32)), "blob": pa.array(out, pa.binary())})


def _spread(x: np.ndarray, parts: int) -> np.ndarray:
    return ((x.view(U64) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def _post(parts: int, hot: np.ndarray):
    """Every shingle to the partition of its hash, hot ones to that of their node, as lists by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", SEND_BYTES):
            doc, s, n = shingle_sets(b.column("text"))
            if not len(s):
                continue
            fa, fb = _names(doc, s, n)
            # Of the texts with one and the same set, one will do.
            order = np.lexsort((fb, fa))
            once = np.zeros(len(n), bool)
            once[order] = np.r_[True, (fa[order][1:] != fa[order][:-1]) | (fb[order][1:] != fb[order][:-1])]
            some = once[doc]
            doc, s = doc[some], s[some]
            to = np.where(np.isin(s.view(np.int64), hot), _spread(fa[doc], parts), _spread(mix(s), parts))
            order = np.lexsort((doc, to))
            doc, s, to = doc[order], s[order], to[order]
            cell = to * len(n) + doc
            first, size = spans(cell)
            owner = np.repeat(np.arange(len(first)), size)
            d = doc[first]
            yield _blobs(to[first], {"fa": pa.array(fa[d]), "fb": pa.array(fb[d]), "n": pa.array(n[d], pa.int32()), "s": _lists(owner, s.view(np.int64), len(first))})

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    trim()
    tables = [from_blob(x.as_buffer()) for b in batches for x in b.column("blob")]
    return pa.concat_tables(tables).combine_chunks() if tables else None


def _by_node(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's node, and a row of each node."""
    fa, fb = t.column("fa").to_numpy(), t.column("fb").to_numpy()
    order = np.lexsort((fb, fa))
    new = np.r_[True, (fa[order][1:] != fa[order][:-1]) | (fb[order][1:] != fb[order][:-1])]
    node = np.empty(len(fa), np.int64)
    node[order] = np.cumsum(new) - 1
    return node, order[new]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    c = column.combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    at = c.offsets.to_numpy()
    return np.diff(at), c.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]


def _share(parts: int, hot: np.ndarray):
    """A partition's shingles to those that two or more nodes have, with their frequency, sent to the nodes' partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _gather(batches)
        if t is None:
            return
        node, row = _by_node(t)
        size, s = _flat(t.column("s"))
        node = np.repeat(node, size)
        order = np.argsort(s)
        near = s[order[1:]] == s[order[:-1]]
        member = np.zeros(len(s), bool)
        member[1:] |= near
        member[:-1] |= near
        order = order[member | np.isin(s[order], hot)]
        if not len(order):
            return
        s, node = s[order], node[order]
        order = np.lexsort((node, s))
        s, node = s[order], node[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (node[1:] != node[:-1])]
        s, node = s[new], node[new]
        first, df = spans(s)
        df = np.repeat(df, df)
        df[np.isin(s, hot)] = EVERYWHERE
        s, node, df = s[df > 1], node[df > 1], df[df > 1]
        order = np.argsort(node, kind="stable")
        s, node, df = s[order], node[order], df[order]
        first, size = spans(node)
        r = row[node[first]]
        owner = np.repeat(np.arange(len(first)), size)
        fa = t.column("fa").to_numpy()[r]
        yield _blobs(_spread(fa, parts), {
            "fa": pa.array(fa), "fb": pa.array(t.column("fb").to_numpy()[r]), "n": pa.array(t.column("n").to_numpy()[r]),
            "s": _lists(owner, s, len(first)), "df": _lists(owner, df.astype(np.int32), len(first)),
        })

    return run


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that share at least what any link needs, with their shared shingles in ascending order and their prefixes."""
    t = _gather(batches)
    if t is None:
        return
    node, row = _by_node(t)
    size, s = _flat(t.column("s"))
    _, df = _flat(t.column("df"))
    node = np.repeat(node, size)
    n = t.column("n").to_numpy()[row].astype(np.int64)
    alive = np.bincount(node, minlength=len(row)) >= _need(n)
    keep = alive[node]
    s, df, node = s[keep], df[keep], node[keep]
    order = np.lexsort((s, node))
    s, df, node = s[order], df[order], node[order]
    place = np.cumsum(alive) - 1
    r, owner, rows = row[alive], place[node], int(alive.sum())
    if rows:
        n, size = n[alive], np.bincount(owner, minlength=rows)
        prefixes = {f"p{k}": _lists(*_prefixes(size, s, df, n, k), rows) for k in range(ORDERS)}
        out = pa.RecordBatch.from_pydict({"fa": pa.array(t.column("fa").to_numpy()[r]), "fb": pa.array(t.column("fb").to_numpy()[r]), "n": pa.array(n.astype(np.int32)), "s": _lists(owner, s, rows)} | prefixes)
        for a in range(0, rows, 512):
            yield out.slice(a, 512)


class _Union:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _similar(a: np.ndarray, b: np.ndarray, n: int, m: int) -> bool:
    """Whether two sets link; a and b are the sorted shingles that they share with any set."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (n + m - common)


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node once per list, with the smallest hash of its shingles there."""
    for b in batches:
        size, s = _flat(pa.chunked_array([b.column("s")]))
        if not len(size):
            continue
        first = np.cumsum(size) - size
        for k in range(LISTS):
            low = np.minimum.reduceat(mix(s.view(U64) ^ _ORDER[k]), first)
            yield pa.RecordBatch.from_pydict({"list": pa.array(np.full(len(size), k, np.int32)), "low": pa.array(low.view(np.int64)), **{c: b.column(c) for c in ("node", "n", "s")}})


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links between neighbours of a sorted list; what the task has joined isn't verified again."""
    union, recent, at = _Union(), [], None
    for b in batches:
        out = []
        lists, low, node, n = (b.column(c).to_pylist() for c in ("list", "low", "node", "n"))
        size, s = _flat(pa.chunked_array([b.column("s")]))
        ends = np.cumsum(size)
        for i, x in enumerate(node):
            if (lists[i], low[i]) != at:
                at, recent = (lists[i], low[i]), []
            mine = s[ends[i] - size[i] : ends[i]]
            for y, m, other in recent:
                if 4 * min(n[i], m) >= 3 * max(n[i], m) and union.find(x) != union.find(y) and _similar(mine, other, n[i], m):
                    union.join(x, y)
                    out.append((x, y))
            recent = [*recent[-NEIGHBOURS + 1 :], (x, n[i], mine.copy())]
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _prefixes(size: np.ndarray, s: np.ndarray, df: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of each row's prefix under order k. Shingles that no other node has would come first; they are absent."""
    row = np.repeat(np.arange(len(size)), size)
    rank = np.frexp(df.astype(np.float64))[1]
    order = np.lexsort((mix(s.view(U64) ^ _ORDER[k]), rank, row))
    place = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
    keep = place < np.repeat(size - _need(n.astype(np.int64)) + 1, size)
    return row[keep], s[order][keep]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, node, s): every node's prefix under every order."""
    for b in batches:
        for k in range(ORDERS):
            size, token = _flat(pa.chunked_array([b.column(f"p{k}")]))
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(token), k, np.int32)), "node": b.column("node").take(pa.array(np.repeat(np.arange(len(size)), size))), "s": pa.array(token)})


def _compare(t: pa.Table) -> pa.Table:
    """Links between different groups, by their names, in a pair of blocks (side 0 and 1), or within one (all rows side 2)."""
    comp, n, side = (t.column(c).to_numpy() for c in ("comp", "n", "side"))
    size, s = _flat(t.column("s"))
    rows = len(comp)
    ends = np.cumsum(size)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    may = np.ones((rows, rows), bool)
    for k in range(ORDERS):
        lengths, token = _flat(t.column(f"p{k}"))
        order = np.argsort(token, kind="stable")
        row = np.repeat(np.arange(rows), lengths)[order]
        shared = np.zeros((rows, rows), bool)
        first, count = spans(token[order])
        for a, c in zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            r = row[a : a + c]
            shared[r[:, None], r] = True
        may &= shared
    may &= comp[:, None] != comp
    may &= 4 * np.minimum(n[:, None], n).astype(np.int64) >= 3 * np.maximum(n[:, None], n)
    # What two sets have in common is among the shingles that each shares with any set.
    may &= 175 * np.minimum(size[:, None], size).astype(np.int64) >= 75 * (n[:, None].astype(np.int64) + n)
    allowed = np.zeros((rows, rows), bool)
    allowed[np.ix_(left, right)] = True
    may &= np.triu(allowed | allowed.T, 1)
    union, out = _Union(), []
    for i in np.flatnonzero(may.any(1)).tolist():
        js = np.array([j for j in np.flatnonzero(may[i]).tolist() if union.find(int(comp[i])) != union.find(int(comp[j]))])
        if not len(js):
            continue
        mine = s[ends[i] - size[i] : ends[i]]
        c = size[js]
        begin = np.cumsum(c) - c
        theirs = s[np.repeat(ends[js] - c - begin, c) + np.arange(c.sum())]
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        common = np.add.reduceat(hit.astype(np.int64), begin)
        for j in js[100 * common >= 75 * (int(n[i]) + n[js] - common)].tolist():
            if union.join(int(comp[i]), int(comp[j])):
                out.append((int(comp[i]), int(comp[j])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _lists_of(postings: DataFrame) -> DataFrame:
    """(home, node, comp): nodes of different groups that post under one list; postings: (k, node, comp, s).

    Only nodes count that share a posting with another group under every order. The groups that post a shingle
    first are its list, known by its size and two sums over it; shingles of equal lists have one home, named by
    the smallest of them.
    """
    shared = postings.groupBy("k", "s").agg(F.min("comp").alias("low"), F.max("comp").alias("top")).where("low < top").select("k", "s")
    met = cut(postings.join(shared, ["k", "s"], "left_semi"))
    every = met.groupBy("node").agg(F.count_distinct("k").alias("orders")).where(F.col("orders") == ORDERS).select("node")
    first = cut(met.where("k = 0").join(every, "node", "left_semi").select("node", "comp", "s"))
    names = [F.count("*").alias("c"), F.sum(F.xxhash64("comp").cast("decimal(20,0)")).alias("h1"), F.bit_xor(F.xxhash64("comp", F.lit(1))).alias("h2")]
    lists = first.select("comp", "s").distinct().groupBy("s").agg(*names).where("c > 1")
    homes = lists.join(lists.groupBy("c", "h1", "h2").agg(F.min("s").alias("home")), ["c", "h1", "h2"]).select("s", "home")
    return cut(first.join(homes, "s").select("home", "node", "comp").distinct())


def _blocks(members: DataFrame) -> DataFrame:
    """(node, cell, side): nodes of clusters of several groups, in all pairs of blocks that hold different groups."""
    sizes = members.groupBy("cluster", "comp").agg(F.count("*").alias("size"))
    big = F.col("size") > BLOCK // 2
    of_cluster = sizes.groupBy("cluster").agg(F.count("*").alias("comps"), F.sum("size").alias("all"), F.sum(F.when(big, 0).otherwise(F.col("size"))).alias("small"))
    known = members.join(sizes.join(of_cluster.where("comps > 1"), "cluster"), ["cluster", "comp"])
    # A large group is dealt by node, small ones whole, so no block of a large group is compared with another.
    of_big = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") * 2 / BLOCK))
    of_small = F.pmod(F.xxhash64("comp"), F.greatest(F.ceil(F.col("small") * 2 / BLOCK), F.lit(1)))
    # Small clusters share blocks; what else may meet there is compared as well.
    tiny = F.col("all") <= BLOCK // 2
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    pool = F.pmod(F.xxhash64("cluster"), F.lit(max(1, 2 * total // BLOCK)))
    known = known.select(
        "node", "cluster", tiny.alias("tiny"),
        F.when(tiny, pool).otherwise(F.col("cluster")).alias("home"),
        F.when(~tiny & big, F.col("comp")).alias("group"),
        F.when(tiny, F.lit(0)).when(big, of_big).otherwise(of_small).cast("bigint").alias("slot"),
    ).withColumn("block", F.concat_ws("/", F.col("tiny").cast("string"), "home", F.coalesce(F.col("group").cast("string"), F.lit("-")), "slot"))
    known = cut(known.dropDuplicates(["node", "block"]), total)
    one = known.select(F.concat_ws("/", F.col("tiny").cast("string"), "home").alias("home"), "group", "block").distinct()
    two = one.select("home", F.col("group").alias("group2"), F.col("block").alias("block2"))
    pairs = one.join(two, "home").where("block <= block2 AND (group IS NULL OR group2 IS NULL OR group <> group2)")
    cell = F.concat_ws("|", "block", "block2").alias("cell")
    same = F.col("block") == F.col("block2")
    sides = pairs.select(cell, F.explode(F.when(same, F.array(F.struct("block", F.lit(2).alias("side")))).otherwise(F.array(F.struct("block", F.lit(0).alias("side")), F.struct(F.col("block2").alias("block"), F.lit(1).alias("side"))))).alias("x"))
    return known.select("node", "block").join(sides.select("cell", "x.*"), "block").select("node", "cell", "side")


def _grouped(docs: DataFrame, by_row: bool) -> DataFrame:
    """(doc_id, n, group) of every row of ``docs`` (doc_id, text), and with ``by_row`` its text_key.

    A group is named by a node's name: the smallest id of the node's rows, or a hash of its set. With ``by_row``
    no two nodes have one name: of the sets that share their smallest id, all but one are named by hash.
    """
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    keyed = texts.withColumn("text_key", text_key()) if by_row else texts
    told = shuffle_partitions(spark)
    all_rows = cut(keyed.mapInArrow(_nodes(told), f"doc_id bigint, {'text_key bigint, ' * by_row}fa bigint, fb bigint, n int, key bigint, weight bigint"))
    rows = all_rows.where("fa IS NOT NULL").drop("key", "weight")
    hot, total = heavy_keys(all_rows.where("fa IS NULL").select("key", "weight"), told, LEAST_HOT)
    parts = max(told, total // PART_SHINGLES)
    hashed = F.lit(NAMELESS) + F.col("fa").bitwiseAND(NAMELESS - 1)
    sets = rows.where("n > 0").groupBy("fa", "fb", "n").agg(F.coalesce(F.min("doc_id"), hashed).alias("node"))
    if by_row:
        first = F.row_number().over(Window.partitionBy("node").orderBy("fa", "fb", "n")) == 1
        sets = cut(sets.withColumn("first", first).select("fa", "fb", "n", F.when(F.col("first"), F.col("node")).otherwise(hashed).alias("node")))

    shared = by_partition(texts.mapInArrow(_post(parts, hot), "part int, blob binary"), parts, "part").mapInArrow(_share(parts, hot), "part int, blob binary")
    prefixes = ", ".join(f"p{k} array<bigint>" for k in range(ORDERS))
    alive = by_partition(shared, parts, "part").mapInArrow(_enough, f"fa bigint, fb bigint, n int, s array<bigint>, {prefixes}")
    alive = cut(alive.join(sets, ["fa", "fb", "n"]).drop("fa", "fb"))

    lists = alive.select("node", "n", "s").mapInArrow(_orders, "list int, low bigint, node bigint, n int, s array<bigint>")
    order = ["list", "low", "n", "node"]
    links = cut(lists.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_chains, "a bigint, b bigint"))
    n_alive = alive.count()
    # comp: the chained group of every node that is still in.
    comps = cut(alive.select("node").join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("comp")), n_alive)
    # Only prefixes move to meet the groups of their nodes.
    postings = cut(alive.mapInArrow(_postings, "k int, node bigint, s bigint").join(comps, "node"))
    members = _lists_of(postings).withColumnRenamed("home", "cluster")
    placed = _blocks(members).join(comps, "node").join(alive, "node").select("cell", "side", "comp", "n", "s", *[f"p{k}" for k in range(ORDERS)])
    more = components(cut(placed.groupBy("cell").applyInArrow(_compare, "a bigint, b bigint")))
    groups = comps.join(more.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("component", "comp").alias("component"))
    named = sets.join(groups, "node", "left").select(F.col("fa").alias("_fa"), F.col("fb").alias("_fb"), F.col("n").alias("_n"), F.coalesce("component", "node").alias("group"))
    out = rows.join(named, (rows.fa == F.col("_fa")) & (rows.fb == F.col("_fb")) & (rows.n == F.col("_n")), "left")
    return out.select("doc_id", *["text_key"] * by_row, "n", "group")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    group = F.when(F.col("group") < NAMELESS, F.col("group"))
    return _grouped(docs, False).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, group).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, rows without an id last.

    A row is known by id and text. Texts without words have no group: each of them stays, rows that repeat both
    id and text as one, and without an id all of them.
    """
    per = cut(_grouped(docs, True).groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"), F.first("group").alias("group")))
    best = F.min_by(F.struct("doc_id", "text_key", "rows"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    grouped = per.where("group IS NOT NULL").groupBy("group").agg(best.alias("x")).select("x.*", F.col("x.rows").alias("most"))
    single = per.where("group IS NULL").select("doc_id", "text_key", "rows", F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("rows")).alias("most"))
    id_, key, repeats = (free(docs, c) for c in ("id", "key", "repeats"))
    chosen = cut(grouped.union(single)).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), (F.col("most") > 1).alias(repeats))
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col(id_)) & (text_key() == F.col(key))
    if chosen.where(repeats).isEmpty():
        return docs.join(chosen, same, "left_semi")
    once = docs.join(chosen.where(~F.col(repeats)), same, "left_semi")
    more = docs.join(chosen.where(repeats), same).dropDuplicates([id_, key]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return once.unionByName(more)
