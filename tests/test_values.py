"""The queries that SQL doesn't express, by value: recomputed with numpy on the smallest tables."""

import itertools

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from scopelens.operators import statistics as st
from scopelens.plans import QUERIES, runlogs, systems
from scopelens.plans.registry import Tables


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


@pytest.fixture(scope="module")
def embedded(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])


def by_pair(t):
    d = {}
    for r in runlogs.paired(t).orderBy("query").collect():
        d.setdefault((r.a, r.b), []).append(r.d)
    return {k: np.array(v) for k, v in d.items()}


def test_permutation_p(spark, sf_dir, t):
    pairs = by_pair(t)
    rows = QUERIES["permutation_p"](spark, sf_dir).collect()
    assert {(r.a, r.b) for r in rows} == set(pairs)
    for r in rows:
        assert r.n == len(pairs[r.a, r.b]) and r.p == pytest.approx(st.permutation_p(pairs[r.a, r.b], 20_000), abs=0.04)


def test_bootstrap_ci(spark, sf_dir, t):
    pairs = by_pair(t)
    for r in QUERIES["bootstrap_ci"](spark, sf_dir).collect():
        d = pairs[r.a, r.b]
        lo, hi = st.bootstrap_ci(d, 8000)
        slack = 0.2 * (hi - lo)
        assert r.ci_low == pytest.approx(lo, abs=slack) and r.ci_high == pytest.approx(hi, abs=slack)


def nmi(a, b):
    ent = lambda x: -sum(p * np.log(p) for p in np.unique(x, return_counts=True)[1] / len(x))
    joint = ent(np.array([f"{x}/{y}" for x, y in zip(a, b, strict=True)]))
    return 2 * (ent(a) + ent(b) - joint) / (ent(a) + ent(b))


def ari(a, b):
    same = lambda x: np.equal.outer(x, x)[np.triu_indices(len(x), 1)]
    x, y = same(np.asarray(a)), same(np.asarray(b))
    both, total = (x & y).sum(), len(x)
    expected = x.sum() * y.sum() / total
    return (both - expected) / ((x.sum() + y.sum()) / 2 - expected)


def clusters(t, k, seed=42):
    return [r.cluster for r in systems.clusters(t, k, seed).orderBy("id").collect()]


def test_kmeans_scopes_and_seeds(spark, sf_dir, t, embedded):
    labels = embedded[2]
    parts = [clusters(t, 8, s) for s in range(3)]
    r = QUERIES["kmeans_scopes"](spark, sf_dir).first()
    own = clusters(t, 8)
    assert r.nmi == pytest.approx(nmi(labels, np.array(own)), abs=1e-5) and r.ari == pytest.approx(ari(labels, own), abs=1e-5)
    got = {(r.seed_a, r.seed_b): r.ari for r in QUERIES["seed_stability"](spark, sf_dir).collect()}
    assert got == {(a, b): pytest.approx(ari(parts[a], parts[b]), abs=1e-5) for a, b in itertools.combinations(range(3), 2)}


def test_granularity_sweep(spark, sf_dir, t, embedded):
    _, x, labels = embedded
    rows = QUERIES["granularity_sweep"](spark, sf_dir).collect()
    for r in rows:
        c = np.array([p.prediction for p in KMeans(featuresCol="x", k=r.k, seed=42, maxIter=20).fit(systems.with_vector(t)).transform(systems.with_vector(t)).orderBy("id").collect()])
        centre = {k: x[c == k].mean(axis=0) for k in np.unique(c)}
        within = sum(((x[c == k] - m) ** 2).sum() for k, m in centre.items())
        between = sum((c == k).sum() * ((m - x.mean(axis=0)) ** 2).sum() for k, m in centre.items())
        assert r.calinski_harabasz == pytest.approx((between / (r.k - 1)) / (within / (len(x) - r.k)), rel=2e-3)
        assert r.nmi_label == pytest.approx(nmi(labels, c), abs=1e-5) and r.nmi_parity == pytest.approx(nmi(labels % 2, c), abs=1e-5)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        far = 1 - u @ u.T
        mean = np.array([[far[i, (c == k) & (np.arange(len(x)) != i)].mean() if ((c == k) & (np.arange(len(x)) != i)).any() else np.nan for k in centre] for i in range(len(x))])
        at = np.array([list(centre).index(k) for k in c])
        a = mean[np.arange(len(x)), at]
        mean[np.arange(len(x)), at] = np.inf
        b = mean.min(axis=1)
        s = np.where(np.isnan(a), 0.0, (b - a) / np.maximum(np.nan_to_num(a), b))
        assert r.silhouette == pytest.approx(s.mean(), abs=0.02)
    fine = max(rows, key=lambda r: r.k)
    assert {r.verdict for r in rows} == {"fine" if fine.nmi_label > fine.nmi_parity + 0.05 else "coarse"}


def test_community_retrieval(spark, sf_dir, t, embedded):
    ids, x, _ = embedded
    c = np.array(clusters(t, 12))
    centre = {k: x[c == k].mean(axis=0) for k in np.unique(c)}
    centre = {k: m / np.linalg.norm(m) for k, m in centre.items()}
    got = {}
    for r in QUERIES["community_retrieval"](spark, sf_dir).collect():
        got.setdefault(r.qid, {}).setdefault(r.community, []).append((r.place, r.id))
    for q, v in zip(ids, x, strict=True):
        order = sorted(centre, key=lambda k: (-round(float(v @ centre[k]), 6), k))[:3]
        for place, k in enumerate(order, 1):
            members = sorted((i for i, m in zip(ids, c, strict=True) if m == k), key=lambda i: (-round(float(x[ids.index(i)] @ centre[k]), 6), i))[:5]
            assert [i for _, i in sorted(got[q][place])] == members


def test_routers_by_fold(spark, sf_dir, embedded):
    labels = embedded[2]
    for name, n in (("logreg_router_cv", len(labels)), ("tfidf_router_cv", None)):
        rows = QUERIES[name](spark, sf_dir).collect()
        assert [r.fold for r in sorted(rows, key=lambda r: r.fold)] == list(range(5))
        assert n is None or sum(r.n for r in rows) == n
        assert all(0 <= r.accuracy <= r.top2 <= 1 for r in rows)
    assert np.mean([r.accuracy for r in rows]) > 0.8  # languages are told apart


def test_trained_route_searches_the_scope_it_names(spark, sf_dir, embedded):
    ids, x, labels = embedded
    sims, of = np.round(x @ x.T, 6), {}
    for r in QUERIES["trained_routed_system"](spark, sf_dir).collect():
        of.setdefault(r.qid, []).append((r["rank"], r.id, r.scope, r.confidence))
    for q, rows in of.items():
        i = ids.index(q)
        scope = int(rows[0][2])
        inside = [j for j in range(len(ids)) if labels[j] == scope and j != i]
        want = [ids[j] for j in sorted(inside, key=lambda j: (-sims[i, j], ids[j]))[:15]]
        assert [r[1] for r in sorted(rows)] == want and 0 < rows[0][3] <= 1
    assert len(of) == len(ids)


def test_recursive_chunks_cover_their_texts(spark, sf_dir, t):
    texts = {r.doc_id: r.text for r in t.documents.select("doc_id", "text").collect()}
    from scopelens.operators.chunking import recursive_chunks

    got: dict = {}
    for r in recursive_chunks(t.documents, "doc_id", "text").collect():
        got.setdefault(r.doc_id, []).append((r.part, r.chunk))
    listed = QUERIES["recursive_chunks"](spark, sf_dir).groupBy("doc_id").agg(F.sum("chars").alias("c"), F.count("*").alias("n")).collect()
    assert {r.doc_id: (r.c, r.n) for r in listed} == {k: (sum(len(c) for _, c in v), len(v)) for k, v in got.items()}
    for doc, text in texts.items():
        chunks = [c for _, c in sorted(got.get(doc, []))]
        assert (text or "").strip() == "" or chunks
        covered = 0
        for c in chunks:
            assert 0 < len(c) <= 1000 and c == c.strip()
            at = text.find(c, max(0, covered - 110))
            assert at >= 0, "chunks are stretches of the text, in order, and carry over no more than asked for"
            assert text[covered:at].strip() == "" or at <= covered, "nothing between two chunks is lost"
            covered = max(covered, at + len(c))
        assert (text or "")[covered:].strip() == ""
