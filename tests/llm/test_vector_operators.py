"""Vector operators, components and the pipeline."""

import collections
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from scopelens.llm import ann, common, hnsw, registry

VECTORS = "vec_id bigint, embedding array<float>, label int"


def table() -> list[tuple]:
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    out = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    out += [(1000 + i, (x[5] + rng.normal(size=16) * 0.03).tolist(), 0) for i in range(60)]  # a large near group
    out += [(2000 + i, x[7].tolist(), 0) for i in range(50)]  # copies
    out += [(3000, (x[9] * 3).tolist(), 0), (3001, None, 0), (3002, [0.0] * 16, 0), (3003, [float("nan")] * 16, 0), (3004, [None] * 16, 0), (3005, [float("inf")] + [0.0] * 15, 0), (3006, [], 0)]
    return out


def usable(v) -> bool:
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(table(), VECTORS).repartition(4)


def test_search_against_brute_force(vectors):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in table() if usable(v)]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = collections.defaultdict(list)
    for r in ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want_ids = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(got) == sorted(want_ids)
    hits = 0
    for q in want_ids:
        s = x @ x[ids.tolist().index(q)]
        order = [i for i in np.lexsort((ids, -np.round(s, 9))) if ids[i] != q][:20]
        mine = sorted(got[q])
        assert [r[0] for r in mine] == list(range(1, 21))
        assert all(a[2] >= b[2] for a, b in zip(mine, mine[1:], strict=False))
        hits += len({r[1] for r in mine} & set(ids[order].tolist()))
    assert hits / (20 * len(want_ids)) >= 0.9


def test_search_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 2.0], 0)], VECTORS)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id = 0"), k=5).collect()]
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_near_duplicates_against_brute_force(vectors, spark):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in table() if usable(v)]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    got = {r.vec_id: r for r in hnsw.near_duplicates(vectors).collect()}
    assert len(got) == len(table())
    want = {int(i): int(n) - 1 for i, n in zip(ids, link.sum(1), strict=True)}
    assert sum(got[i].n_links for i in want) >= 0.97 * sum(want.values())
    assert all(got[i].n_links <= n for i, n in want.items())
    assert got[2000].component_id == 7 and got[2049].n_links >= 50 and got[7].kept and not got[2000].kept
    assert got[3000].component_id == 9
    for i in (3001, 3002, 3003, 3004, 3005, 3006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert hnsw.near_duplicates(vectors.limit(0)).count() == 0


def test_near_duplicates_keep_unusable_rows_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, None, 0), (1, [0.0, 0.0], 0), (2, [0.0, 1.0], 0), (2, [float("nan"), 1.0], 0), (None, [1.0, 0.0], 0)], VECTORS)
    got = [(r.vec_id, r.n_links) for r in hnsw.near_duplicates(df).collect()]
    assert sorted(got, key=str) == [(1, 0)] * 3 + [(2, 0)] * 2 + [(None, 0)]


def test_near_duplicates_compare_all_where_no_beam_passes(vectors, monkeypatch):
    monkeypatch.setattr(hnsw, "RECALL", 1.1)  # no beam can pass
    x = np.array([np.array(v, np.float32).astype(float) for _, v, _ in table() if usable(v)])
    ids = [i for i, v, _ in table() if usable(v)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = dict(zip(ids, ((u @ u.T >= 0.9).sum(1) - 1).tolist(), strict=True))
    monkeypatch.setattr(hnsw, "meet", _local(hnsw.meet))
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(vectors).collect()}
    assert {i: got[i] for i in ids} == want


def _local(meet, seen=None):
    """Runs a cell's function in this process, where patches hold."""

    def run(indexed, queries, shards, blocks):
        class Cells:
            def applyInArrow(self, f, schema):
                if seen is not None:
                    seen.append(schema)
                q = queries.toArrow()
                out = [f(pa.table({"index": [r["index"]]}), q).to_pandas() for r in indexed.collect()]
                return indexed.sparkSession.createDataFrame(pd.concat(out), schema)

        return Cells()

    return run


def test_near_duplicates_name_rows_not_ids(spark):
    """Different vectors under one id, some of them near: every row comes back with its own links."""
    v = lambda x: [float(np.cos(x)), float(np.sin(x))]
    rows = [(7, v(0.0)), (7, v(0.1)), (7, v(2.0)), (8, v(2.0)), (9, v(4.0)), (9, v(4.1)), (7, None), (5, v(0.2))]
    got = [(r.vec_id, r.n_links, r.component_id) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()]
    assert sorted(got) == [(5, 2, 5), (7, 0, 7), (7, 1, 7), (7, 2, 5), (7, 2, 5), (8, 1, 7), (9, 1, 9), (9, 1, 9)]


def test_links_of_a_large_component_are_counted_in_blocks(vectors, monkeypatch):
    monkeypatch.setattr(hnsw, "CLASS_ROWS", 16)
    monkeypatch.setattr(hnsw, "CLASS_BYTES", 16 * 8 * 16)
    x = np.array([np.array(v, np.float32).astype(float) for _, v, _ in table() if usable(v)])
    ids = [i for i, v, _ in table() if usable(v)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = dict(zip(ids, ((u @ u.T >= 0.9).sum(1) - 1).tolist(), strict=True))
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(vectors).collect()}
    group = [5, *range(1000, 1060)]
    assert {i: got[i] for i in group} == {i: want[i] for i in group}


def test_forest():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (10, 5), (200, 150), (3000, 2900)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        up = list(range(n))
        def find(i):
            while up[i] != i:
                i = up[i]
            return i
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = find(i), find(j)
            up[max(i, j)] = min(i, j)
        leaf, root = common.forest(a, b)
        assert dict(zip(leaf.tolist(), root.tolist(), strict=True)) == {i: find(i) for i in range(n) if find(i) != i}


def test_audit_weighs_small_groups_like_large_ones(spark, monkeypatch):
    """A search that finds large groups and self matches, but no pair below beam 64, has to be widened."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 32))
    near = lambda v, k: [(v + rng.normal(size=32) * 0.02).tolist() for _ in range(k)]
    rows = [*x.tolist(), *(near(v, 1)[0] for v in x[:60]), *near(x[299], 120)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>").selectExpr("vec_id AS node", "embedding")

    none = np.zeros(0, int)

    def lossy(graph, x, q, least, width):
        r, c = np.nonzero(q @ x.T >= least)
        small = np.bincount(r, minlength=len(q))[r] <= 2
        same = (np.abs(q[r] - x[c]) < 1e-12).all(axis=1)
        ok = ~small | same | (width >= 64)
        return r[ok], c[ok], none

    monkeypatch.setattr(hnsw, "_beams", lossy)
    seen = []
    monkeypatch.setattr(hnsw, "meet", _local(hnsw.meet, seen))
    graphs = hnsw.indexes(df, "node", 1, hnsw._build)
    assert hnsw.audited_width(df, graphs, df.withColumnRenamed("node", "query_id"), len(rows), 1, 0.9) == 64
    assert len(seen) == 1


@pytest.mark.parametrize("n", [1, 2, 5, 70, 600])
def test_graph_finds_its_own_points(n):
    x = np.random.default_rng(n).normal(size=(n, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = hnsw.Graph(x).search(x, 16)
    assert (ids[:, 0] == np.arange(n)).mean() > 0.98


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(80)] + [(2000, 2000 + i) for i in range(1, 90)]
    up = {}

    def find(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: find(v) for v in {x for e in edges if e[0] != e[1] for x in e}}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_words_match_the_pattern():
    import re

    texts = ["", None, "  a  b\tc\x0b", "x", "é è\nù", " ", "last", "first last"]
    w = common.Words(pa.array(texts))
    got = [[bytes(w.bytes[w.start[i] : w.end[i]]).decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    h = w.hashes()
    assert h[w.first[6]] == h[w.first[7] + 1]
    assert len(set(h.tolist())) == len({x for g in got for x in g})


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_text_operators import brute_groups, brute_repeats

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = pipeline.drop_toxic(spark, docs, sf_dir)
    assert one.columns == list(pipeline.COLUMNS)
    a = {r.doc_id: r.text for r in one.collect()}
    b = {i for i, (_, c) in brute_groups(list(a.items())).items() if i == c}
    assert {r.doc_id for r in pipeline.drop_near_copies(spark, one, sf_dir).collect()} == b
    left = one.where(one.doc_id.isin(*b))
    kept = {r.doc_id: r.text for r in pipeline.drop_repeated_passages(spark, left, sf_dir).collect()}
    order = sorted(b)
    assert kept == {i: x[2] for i, x in zip(order, brute_repeats([a[i] for i in order]), strict=True)}
    out = pipeline.run(spark, sf_dir)
    assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "ids", "n_tokens"}
    n = {r.doc_id: r.n for r in out.groupBy("doc_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert set(n) <= b and max(n.values()) <= 3


def test_registry_names():
    import re

    names = [k for k in registry.QUERIES if re.match(r"op\d+_", k)]
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in names) == list(range(1, 14))


def test_a_large_group_of_unequal_vectors_costs_products_not_walks(spark):
    """A tight group, and two tight groups that only loose links join, all wider than any beam."""
    rng = np.random.default_rng(9)
    c, e = rng.normal(size=24), rng.normal(size=24)
    e -= c * (e @ c) / (c @ c)
    unit = lambda v: v / np.linalg.norm(v)
    turned = np.cos(0.44) * unit(c) + np.sin(0.44) * unit(e)  # near the threshold from the first
    far = unit(rng.normal(size=24))
    x = np.concatenate([v + rng.normal(size=(n, 24)) * 0.006 for v, n in ((unit(c), 500), (turned, 500), (far, 700))] + [rng.normal(size=(100, 24))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    cross = linked[:500, 500:1000]
    assert 0 < cross.sum() < cross.size  # some pairs link the two groups, others don't
    low = np.arange(len(x))
    for _ in range(20):
        low = np.where(linked, low, len(x)).min(axis=1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    began = time.time()
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(df).collect()}
    assert time.time() - began < 120
    assert got == {i: (int(linked[i].sum()) - 1, int(low[i])) for i in range(len(x))}


def test_label_groups_join_what_links_join():
    rng = np.random.default_rng(10)
    for _ in range(40):
        n = int(rng.integers(1, 60))
        t = np.sort(rng.random(n) * 6)
        x = np.stack([np.cos(t), np.sin(t)], axis=1)
        pick = rng.permutation(n)[: int(rng.integers(1, n + 1))]
        r, c, a, b = hnsw._groups(x, x[pick], 0.995)
        want = common.forest(*(pick[i] if k == 0 else i for k, i in enumerate(np.nonzero(x[pick] @ x.T >= 0.995))))
        have = common.forest(np.concatenate([pick[r], a]), np.concatenate([c, b]))
        assert dict(zip(*map(np.ndarray.tolist, have), strict=True)) == dict(zip(*map(np.ndarray.tolist, want), strict=True))


def test_rows_that_share_a_query_id_get_their_own_lists(spark):
    rng = np.random.default_rng(11)
    data = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(60, 4)))]
    asked = [(0, [1.0, 0.0, 0.0, 0.0], 0), (0, [0.0, -1.0, 0.0, 0.0], 0), (0, [0.0, -1.0, 0.0, 0.0], 0), (7, [0.0, 0.0, 1.0, 0.0], 0)]
    got = ann.search(spark.createDataFrame(data, VECTORS), spark.createDataFrame(asked, VECTORS), k=20).collect()
    assert collections.Counter(r.query_id for r in got) == {0: 60, 7: 20}
    best = lambda axis, sign: max((sign * np.float32(v[axis]), -i) for i, v, _ in data if i)
    assert sorted((r.score, -r.vec_id) for r in got if r["rank"] == 1 and r.query_id == 0) == sorted([best(0, 1), best(1, -1), best(1, -1)])
    assert sorted(r["rank"] for r in got if r.query_id == 0) == sorted([*range(1, 21)] * 3)
