"""Queries on retrieval: dense, lexical, fused, routed, and the dilution of top-k results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vector import doubles, dot, mean_pool
from ..operators import backends, dense, lexical
from ..operators.fusion import hybrid_merge, interleave, rrf, two_stage
from ..operators.systems import embed
from ..sources.indexes import source_version, token_index, vector_index
from .registry import Tables, query

E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
#: All ordered pairs of different vectors with their rounded similarity and rank.
KNN = f"""{E}, s AS (SELECT a.vec_id AS qid, b.vec_id AS id, a.label AS ql, b.label AS l, round(list_dot_product(a.v, b.v), 6) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM s)"""
#: Every vector against the vectors of each label, its own excluded.
SCOPED = f"{KNN}, p AS (SELECT *, row_number() OVER (PARTITION BY qid, l ORDER BY sim DESC, id) AS srank FROM s)"


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), doubles("embedding").alias("v"), "label")


def as_queries(v: DataFrame) -> DataFrame:
    return v.select(F.col("id").alias("qid"), "v", F.col("label").alias("ql"))


def neighbours(t: Tables, k: int = 10) -> DataFrame:
    """(qid, id, sim, rank, ql, l): the k nearest others of every vector, with both labels."""
    v = vectors(t)
    found = dense.topk(as_queries(v), v, k, exclude_self=True)
    labels = v.select("id", F.col("label").alias("l"))
    own = v.select(F.col("id").alias("qid"), F.col("label").alias("ql"))
    return found.join(labels, "id").join(own, "qid").drop("list")


def purity(t: Tables, k: int = 10) -> DataFrame:
    per_query = neighbours(t, k).groupBy("qid", "ql").agg(F.avg((F.col("ql") == F.col("l")).cast("double")).alias("p"))
    return per_query.groupBy(F.col("ql").alias("label")).agg(F.count("*").alias("n"), F.avg("p").alias("p"))


PURITY = f"{KNN}, q AS (SELECT qid, ql, avg(CASE WHEN ql = l THEN 1.0 ELSE 0.0 END) AS p FROM r WHERE rank <= 10 GROUP BY qid, ql), c AS (SELECT ql AS label, count(*) AS n, avg(p) AS p FROM q GROUP BY ql)"


@query(f"WITH {PURITY} SELECT label, n, round(p, 6) AS purity, round(1 - p, 6) AS dilution FROM c")
def knn_purity_by_label(t: Tables) -> DataFrame:
    return purity(t).select("label", "n", F.round("p", 6).alias("purity"), F.round(1 - F.col("p"), 6).alias("dilution"))


@query(f"WITH {PURITY} SELECT round(sum(n * p) / sum(n), 6) AS purity, round(1 - sum(n * p) / sum(n), 6) AS dilution FROM c")
def knn_dilution_overall(t: Tables) -> DataFrame:
    mean = F.sum(F.col("n") * F.col("p")) / F.sum("n")
    return purity(t).agg(F.round(mean, 6).alias("purity"), F.round(1 - mean, 6).alias("dilution"))


@query(
    f"""WITH {PURITY}, k AS (SELECT round(log10(n), 9) AS x, round(1 - p, 9) AS y FROM c),
a AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM k)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM a"""
)
def knn_dilution_spearman(t: Tables) -> DataFrame:
    from ..operators.statistics import average_rank

    # One row per label from here on.
    k = purity(t).select(F.round(F.log10("n"), 9).alias("x"), F.round(1 - F.col("p"), 9).alias("y"))
    a = k.select(average_rank("x").alias("rx"), average_rank("y").alias("ry"))
    return a.agg(F.count("*").alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


@query(
    f"""WITH {E}, s AS (SELECT a.vec_id AS qid, a.label AS ql, b.label AS l, b.vec_id AS id, round(list_dot_product(a.v, b.v), 6) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.label < 5 AND b.label < 5),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM s),
q AS (SELECT qid, ql, avg(CASE WHEN ql = l THEN 1.0 ELSE 0.0 END) AS p FROM r WHERE rank <= 10 GROUP BY qid, ql)
SELECT ql AS label, count(*) AS n, round(avg(p), 6) AS purity FROM q GROUP BY ql"""
)
def knn_dilution_restricted(t: Tables) -> DataFrame:
    """The corpus is restricted to some labels before neighbours are sought."""
    v = vectors(t).where("label < 5")
    found = dense.topk(as_queries(v), v, 10, exclude_self=True)
    labels = v.select("id", F.col("label").alias("l"))
    q = found.join(labels, "id").join(v.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid")
    per = q.groupBy("qid", "ql").agg(F.avg((F.col("ql") == F.col("l")).cast("double")).alias("p"))
    return per.groupBy(F.col("ql").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("purity"))


@query(
    f"""WITH {KNN}, x AS (SELECT r.qid, r.rank, u.axis, u.a = u.b AS same FROM r, LATERAL (VALUES ('label', r.ql::VARCHAR, r.l::VARCHAR), ('parity', (r.ql % 2)::VARCHAR, (r.l % 2)::VARCHAR), ('label::parity', r.ql || '::' || (r.ql % 2), r.l || '::' || (r.l % 2))) AS u(axis, a, b) WHERE r.rank <= 10)
SELECT axis, round(avg(same::INT), 6) AS purity FROM x GROUP BY axis"""
)
def knn_purity_multi_axis(t: Tables) -> DataFrame:
    """Several label axes from one pass over the neighbours."""
    nb = neighbours(t)
    pair = lambda name, f: F.struct(F.lit(name).alias("axis"), (f("ql") == f("l")).alias("same"))
    both = lambda c: tx.compose_label(F.col(c).cast("string"), (F.col(c) % 2).cast("string"))
    axes = F.array(pair("label", F.col), pair("parity", lambda c: F.col(c) % 2), pair("label::parity", both))
    return nb.select(F.explode(axes).alias("x")).groupBy("x.axis").agg(F.round(F.avg(F.col("x.same").cast("int")), 6).alias("purity"))


@query(f"WITH {KNN} SELECT qid, id, sim FROM s WHERE sim >= 0.45 AND qid < id")
def near_duplicate_pairs(t: Tables) -> DataFrame:
    v = vectors(t)
    return dense.similar(as_queries(v), v, 0.45).where("qid < id").select("qid", "id", "sim")


@query(f"WITH {KNN} SELECT qid, id, sim, rank FROM r WHERE rank <= 10")
def dense_topk_global(t: Tables) -> DataFrame:
    return neighbours(t).select("qid", "id", "sim", F.col("rank").cast("bigint"))


@query(f"WITH {SCOPED} SELECT qid, id, sim, srank AS rank FROM p WHERE l = ql AND srank <= 10")
def dense_topk_scoped_pre(t: Tables) -> DataFrame:
    v = vectors(t).withColumn("scope", F.col("label").cast("string"))
    q = v.withColumnRenamed("id", "qid")
    return dense.topk(q, v, 10, exclude_self=True).select("qid", "id", "sim", F.col("rank").cast("bigint"))


@query(f"WITH {KNN}, f AS (SELECT qid, id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM r WHERE rank <= 90 AND l = ql) SELECT * FROM f WHERE rank <= 15")
def dense_topk_scoped_post(t: Tables) -> DataFrame:
    """Candidates first, filter second: lists may come out short."""
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "id")
    kept = neighbours(t, 90).where("l = ql")
    return kept.withColumn("rank", F.row_number().over(w)).where("rank <= 15").select("qid", "id", "sim", F.col("rank").cast("bigint"))


@query(f"WITH {KNN}, f AS (SELECT qid, id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM r WHERE rank <= 60 AND l < 5) SELECT * FROM f WHERE rank <= 15")
def dense_global_post_filter(t: Tables) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "id")
    kept = neighbours(t, 60).where("l < 5")
    return kept.withColumn("rank", F.row_number().over(w)).where("rank <= 15").select("qid", "id", "sim", F.col("rank").cast("bigint"))


CENTROIDS = """flat AS (SELECT label, i, avg(v[i]) AS x FROM e, generate_series(1, 64) AS g(i) GROUP BY label, i),
m AS (SELECT label, list(x ORDER BY i) AS c FROM flat GROUP BY label),
u AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM m),
t AS (SELECT e.vec_id AS qid, u.label AS scope, round(list_dot_product(e.v, u.c), 6) AS sim FROM e, u),
rt AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, scope) AS rank FROM t)"""


def centroids(t: Tables) -> DataFrame:
    return mean_pool(t.embeddings, ["label"], "embedding")


def route(t: Tables, m: int) -> DataFrame:
    """(qid, scope, sim, rank): the m scopes whose centroid is nearest to each vector."""
    v = vectors(t)
    found = dense.topk(as_queries(v), centroids(t).withColumnRenamed("label", "id"), m)
    return found.select("qid", F.col("id").cast("int").alias("scope"), "sim", "rank")


@query(f"WITH {E}, {CENTROIDS} SELECT label, i AS pos, round(c[i], 6) AS x FROM u, generate_series(1, 64) AS g(i)")
def vector_mean_pool(t: Tables) -> DataFrame:
    return centroids(t).select("label", F.posexplode("v").alias("pos", "x")).select("label", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {E}, {CENTROIDS} SELECT qid, scope, sim, rank FROM rt WHERE rank <= 2")
def centroid_router_top2(t: Tables) -> DataFrame:
    return route(t, 2).select("qid", "scope", "sim", F.col("rank").cast("bigint"))


@query(
    f"""WITH {SCOPED}, {CENTROIDS},
lists AS (SELECT qid, 'g' AS list, id, rank, 0.5 AS w FROM r WHERE rank <= 15
  UNION ALL SELECT p.qid, p.l::VARCHAR, p.id, p.srank, 1.0 FROM p JOIN rt ON rt.qid = p.qid AND rt.scope = p.l AND rt.rank <= 2 WHERE p.srank <= 15),
f AS (SELECT qid, id, round(sum(w / (60 + rank)), 6) AS score FROM lists GROUP BY qid, id),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f)
SELECT qid, id, score, rank FROM o WHERE rank <= 10"""
)
def soft_scoped_rrf(t: Tables) -> DataFrame:
    """Lists of the two nearest scopes and a global list at half weight, fused by reciprocal rank."""
    v = vectors(t)
    corpus = v.withColumn("scope", F.col("label").cast("string"))
    scopes = route(t, 2).select("qid", F.col("scope").cast("string").alias("scope"))
    asked = as_queries(v).select("qid", "v")
    lists = asked.join(scopes, "qid").withColumn("list", F.col("scope"))
    lists = lists.unionByName(asked.select("qid", "v", F.lit(None).cast("string").alias("scope"), F.lit("g").alias("list")))
    found = dense.topk(lists, corpus, 15, exclude_self=True)
    return rrf(found.withColumn("w", F.when(F.col("list") == "g", 0.5).otherwise(1.0)), 10)


@query(
    f"""WITH {SCOPED}, {CENTROIDS}, c AS (SELECT p.qid, rt.rank AS no, p.id, p.srank FROM p JOIN rt ON rt.qid = p.qid AND rt.scope = p.l AND rt.rank <= 4 WHERE p.srank <= 15 // 4 + CASE WHEN rt.rank <= 15 % 4 THEN 1 ELSE 0 END)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY srank, no) AS pos FROM c"""
)
def composed_round_robin(t: Tables) -> DataFrame:
    """15 places dealt over four scopes (4, 4, 4, 3), their lists interleaved."""
    v = vectors(t)
    corpus = v.withColumn("scope", F.col("label").cast("string"))
    scopes = route(t, 4).select("qid", F.col("scope").cast("string").alias("scope"), F.col("rank").alias("no"))
    lists = as_queries(v).select("qid", "v").join(scopes, "qid").withColumn("list", F.col("no").cast("string"))
    found = dense.topk(lists.drop("no"), corpus, 4, exclude_self=True).withColumn("no", F.col("list").cast("int"))
    return interleave(found, total=15, lists=4)


@query(
    f"""WITH {KNN}, pool AS (SELECT qid, id, l AS doc, sim, row_number() OVER (PARTITION BY qid, l ORDER BY sim DESC, id) AS n FROM r WHERE rank <= 200),
d AS (SELECT qid, doc, round(avg(sim), 9) AS prior FROM pool WHERE n <= 3 GROUP BY qid, doc),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY prior DESC, doc) AS n FROM d),
z AS (SELECT qid, doc, CASE WHEN stddev_pop(prior) OVER q = 0 THEN 0 ELSE (prior - avg(prior) OVER q) / stddev_pop(prior) OVER q END AS z FROM k WHERE n <= 5 WINDOW q AS (PARTITION BY qid)),
lo AS (SELECT qid, min(z) AS lo FROM z GROUP BY qid),
f AS (SELECT pool.qid, pool.id, round(sim + 0.1 * coalesce(z.z, lo.lo), 6) AS score FROM pool JOIN lo USING (qid) LEFT JOIN z ON z.qid = pool.qid AND z.doc = pool.doc),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f)
SELECT qid, id, score, rank FROM o WHERE rank <= 10"""
)
def two_stage_doc_prior(t: Tables) -> DataFrame:
    """A label stands for a document: its prior is the mean of its best three rows in a pool of 200."""
    return two_stage(neighbours(t, 200).withColumnRenamed("l", "doc"), docs=5, k=10)


@query(
    f"""WITH {KNN}, c AS (SELECT id, count(*) AS n FROM r WHERE rank <= 10 GROUP BY id), h AS (SELECT e.vec_id, coalesce(c.n, 0) AS n FROM e LEFT JOIN c ON c.id = e.vec_id),
m AS (SELECT avg(n) AS m, stddev_pop(n) AS s FROM h), o AS (SELECT n, row_number() OVER (ORDER BY n DESC, vec_id) AS k, count(*) OVER () AS all_n FROM h)
SELECT (SELECT count(*) FROM h) AS points, (SELECT max(n) FROM h) AS most, (SELECT count(*) FROM h WHERE n = 0) AS antihubs,
 (SELECT round(avg(power((n - m) / s, 3)), 6) FROM h, m) AS skew, (SELECT round(sum(n) FILTER (k <= greatest(1, all_n // 100)) / sum(n), 6) FROM o) AS top_share"""
)
def hubness_counts(t: Tables) -> DataFrame:
    """How often each vector is a neighbour, zeros included; the top hundredth's share by a distributed threshold."""
    counts = neighbours(t).groupBy("id").agg(F.count("*").alias("n"))
    h = vectors(t).select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    total = h.agg(F.count("*").alias("points"), F.sum("n").alias("all"), F.max("n").alias("most"), F.sum((F.col("n") == 0).cast("bigint")).alias("antihubs"), F.round(F.skewness("n"), 6).alias("skew"))
    # Counts by value are few rows, so a running sum over them finds how many of which value lie in the top.
    by = Window.orderBy(F.desc("n"))
    hist = h.groupBy("n").agg(F.count("*").alias("c"))
    run = hist.crossJoin(F.broadcast(total.select("points"))).withColumn("before", F.sum("c").over(by) - F.col("c"))
    quota = F.greatest(F.floor(F.col("points") / 100), F.lit(1))
    top = run.agg(F.sum(F.col("n") * F.greatest(F.least(F.col("c"), quota - F.col("before")), F.lit(0))).alias("top"))
    return total.crossJoin(F.broadcast(top)).select("points", "most", "antihubs", "skew", F.round(F.col("top") / F.col("all"), 6).alias("top_share"))


@query(f"WITH {KNN} SELECT count(*) AS pairs, round(avg(x), 6) AS mean_cos, round(stddev_pop(x), 6) AS sd_cos FROM (SELECT list_dot_product(a.v, b.v) AS x FROM e a JOIN e b ON a.vec_id <> b.vec_id)")
def pair_cosine_stats(t: Tables) -> DataFrame:
    m = dense.moments(vectors(t))
    mean = F.col("total") / F.col("n")
    return m.select(F.col("n").cast("bigint").alias("pairs"), F.round(mean, 6).alias("mean_cos"), F.round(F.sqrt(F.col("squares") / F.col("n") - mean * mean), 6).alias("sd_cos"))


AUC = """SELECT label, round((sum(rk) FILTER (same) - count(*) FILTER (same) * (count(*) FILTER (same) + 1) / 2.0) / (count(*) FILTER (same) * count(*) FILTER (NOT same)), 6) AS auc FROM k GROUP BY label"""


@query(
    f"""WITH {E}, {CENTROIDS}, s AS (SELECT scope AS label, sim, e.label = scope AS same FROM t JOIN e ON e.vec_id = t.qid),
k AS (SELECT label, same, rank() OVER (PARTITION BY label ORDER BY sim) + (count(*) OVER (PARTITION BY label, sim) - 1) / 2.0 AS rk FROM s) {AUC}"""
)
def label_auc_mannwhitney(t: Tables) -> DataFrame:
    """How well nearness to a label's centroid tells its own vectors from others."""
    from ..operators.statistics import auc_by

    own = vectors(t).select(F.col("id").alias("qid"), F.col("label").alias("own"))
    s = route(t, 10).join(own, "qid").select(F.col("scope").alias("label"), "sim", (F.col("own") == F.col("scope")).alias("same"))
    return auc_by(s, "label", "sim", "same")


@query(f"WITH {E} SELECT vec_id, round(sqrt(list_dot_product(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))))), 6) AS length, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM e")
def normalise_vectors(t: Tables) -> DataFrame:
    from ..functions.vector import norm, unit

    v = t.embeddings.select("vec_id", unit(doubles("embedding")).alias("v"))
    return v.select("vec_id", F.round(norm(F.col("v")), 6).alias("length"), F.round(F.element_at("v", 1), 6).alias("first"))


@query(
    f"""WITH {E}, tk AS (SELECT vec_id, j, list_slice(v, 8 * j + 1, 8 * j + 8) AS tok, label FROM e, generate_series(0, 7) AS g(j)), q AS (SELECT DISTINCT ON (label) label, vec_id FROM e ORDER BY label, vec_id),
s AS (SELECT q.label, d.vec_id AS id, a.j, max(list_dot_product(a.tok, d.tok)) AS m FROM q JOIN tk a USING (vec_id) JOIN tk d ON true GROUP BY q.label, d.vec_id, a.j),
f AS (SELECT label, id, round(sum(m), 6) AS score FROM s GROUP BY label, id), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM f) SELECT label, id, score, rank FROM o WHERE rank <= 10"""
)
def late_interaction_topk(t: Tables) -> DataFrame:
    """Each vector read as eight token vectors: per query token the best document token, summed. One query per label."""
    v = vectors(t)
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.slice(c, j * 8 + 1, F.lit(8)))
    # Every shard of the vectors meets every query.
    shards = max(1, t.spark.sparkContext.defaultParallelism)
    first = v.groupBy("label").agg(F.min_by("v", "id").alias("q")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    best = lambda q, d: F.aggregate(cut(q), F.lit(0.0), lambda s, a: s + F.array_max(F.transform(cut(d), lambda b: dot(a, b))))
    s = v.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")).join(first, "shard").select("label", "id", F.round(best(F.col("q"), F.col("v")), 6).alias("score"))
    return lexical.ranked(s, "label", "id", 10).select("label", "id", "score", F.col("rank").cast("bigint"))


def as_tokens(t: Tables) -> DataFrame:
    """Each vector read as eight token vectors."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.slice("v", j * 8 + 1, F.lit(8)))
    return vectors(t).select("id", cut.alias("tokens"), F.col("label").cast("string").alias("scope"))


LATE = f"""{E}, tk AS (SELECT vec_id, j, list_slice(v, 8 * j + 1, 8 * j + 8) AS tok, label FROM e, generate_series(0, 7) AS g(j)),
s AS (SELECT a.vec_id AS qid, d.vec_id AS id, a.label AS ql, d.label AS l, a.j, max(list_dot_product(a.tok, d.tok)) AS m FROM tk a JOIN tk d ON a.vec_id <> d.vec_id WHERE a.vec_id % 25 = 0 GROUP BY ALL),
f AS (SELECT qid, id, ql, l, round(sum(m), 6) AS score FROM s GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f)"""


@query(f"WITH {LATE} SELECT qid, id, score, rank FROM o WHERE rank <= 10")
def late_interaction_index(t: Tables) -> DataFrame:
    """Late interaction over an index of token vectors: all documents meet all queries in blocks, as in the SQL."""
    index = token_index(as_tokens(t), source_version(t.embeddings.select("vec_id", "embedding", "label")))
    asked = as_tokens(t).where("id % 25 = 0").select(F.col("id").alias("qid"), "tokens")
    return index.search(asked, 10, exclude_self=True).select("qid", "id", "score", F.col("rank").cast("bigint"))


@query(f"WITH {LATE}, c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS pos FROM o WHERE rank <= 40 AND ql = l) SELECT qid, id, score, pos AS rank FROM c WHERE pos <= 10")
def late_interaction_scoped(t: Tables) -> DataFrame:
    """Forty rows first, the query's own label after: lists may come out short."""
    index = token_index(as_tokens(t), source_version(t.embeddings.select("vec_id", "embedding", "label")))
    asked = as_tokens(t).where("id % 25 = 0").select(F.col("id").alias("qid"), "tokens", "scope")
    return index.search(asked, 10, exclude_self=True).select("qid", "id", "score", F.col("rank").cast("bigint"))


T = f"""t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{tx.TOKEN}')) AS term, source FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{tx.TOKEN}')) AS term FROM benchmark) GROUP BY item_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
BM25 = f"""{T}, dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '{tx.TOKEN}')) AS dl, source FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM df, st), mn AS (SELECT avg(raw) AS m FROM raw), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw, mn),
b AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY item_id, doc_id HAVING round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) > 0),
br AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM b)"""


@query(f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM br WHERE rank <= 10")
def bm25_topk_global(t: Tables) -> DataFrame:
    return t.text_index().topk(t.benchmark, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {BM25}, sc AS (SELECT b.*, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM b JOIN documents d USING (doc_id) WHERE d.source = 'src' || (item_id % 20)) SELECT item_id, doc_id, score, rank FROM sc WHERE rank <= 10")
def bm25_topk_scoped(t: Tables) -> DataFrame:
    q = t.benchmark.withColumn("source", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    return t.text_index().topk(q, 10, scope="source").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {SCOPED} SELECT qid, id, sim, srank AS rank FROM p WHERE l = 3 AND ql = 3 AND srank <= 10")
def dense_index_one_scope(t: Tables) -> DataFrame:
    """The members of one label among themselves; of the vector index only that label's partition is read."""
    q = as_queries(vectors(t)).where("ql = 3").select("qid", "v", F.col("ql").cast("string").alias("scope"))
    return t.vector_index().topk(q, 10, exclude_self=True).select("qid", "id", "sim", F.col("rank").cast("bigint"))


@query(f"WITH {KNN} SELECT qid, id, sim, rank FROM r WHERE rank <= 5 AND qid % 10 = 0")
def dense_index_topk(t: Tables) -> DataFrame:
    """Every tenth vector's nearest ones in all cells that may hold one, by their angles."""
    q = as_queries(vectors(t)).where("qid % 10 = 0").select("qid", "v")
    return t.vector_index().topk(q, 5, exclude_self=True).select("qid", "id", "sim", F.col("rank").cast("bigint"))


TFIDF = f"""{T}, n AS (SELECT count(*) AS n FROM documents), nq AS (SELECT count(*) AS n FROM benchmark), dq AS (SELECT term, count(*) AS df FROM q GROUP BY term),
dw AS (SELECT doc_id, term, (1 + ln(tf)) * ln(1 + n.n / df.df) AS w FROM tf JOIN df USING (term), n), qw AS (SELECT item_id, term, (1 + ln(qtf)) * ln(1 + nq.n / dq.df) AS w FROM q JOIN dq USING (term), nq),
sp AS (SELECT item_id, doc_id, round(sum(qw.w * dw.w), 6) AS score FROM qw JOIN dw USING (term) GROUP BY item_id, doc_id), sr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sp WHERE score > 0)"""


def sparse_found(t: Tables, k: int) -> DataFrame:
    return backends.Sparse(t.documents, t.text_index()).search(t.benchmark.select("item_id", "text"), k)


@query(f"WITH {TFIDF} SELECT item_id, doc_id, score, rank FROM sr WHERE rank <= 10")
def sparse_dot_topk(t: Tables) -> DataFrame:
    return sparse_found(t, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT vec_id, i - 1 AS term, round(greatest(ln(1 + greatest(max(x), 0)), 0), 6) AS w FROM (SELECT vec_id, (i - 1) % 8 + 1 AS i, embedding[i]::DOUBLE AS x FROM embeddings, generate_series(1, 64) AS g(i)) GROUP BY vec_id, i")
def sparse_max_pooling(t: Tables) -> DataFrame:
    """Vector components stand for token logits of eight terms."""
    flat = t.embeddings.select(F.col("vec_id").alias("id"), F.posexplode(doubles("embedding")).alias("pos", "logit"))
    w = lexical.max_pool(flat.select("id", (F.col("pos") % 8).cast("bigint").alias("term"), "logit"))
    return w.withColumnRenamed("id", "vec_id")


STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
KEYWORDS = f"SELECT item_id, list_filter(string_split_regex(trim(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')), '\\s+'), lambda w: length(w) > 2 AND lower(w) NOT IN ({STOP}))[1:8] AS kw FROM benchmark"


@query(
    f"""WITH {BM25.replace("SELECT item_id, unnest(regexp_extract_all(lower(text), '" + tx.TOKEN + "')) AS term FROM benchmark", f"SELECT item_id, unnest(regexp_extract_all(lower(array_to_string(kw, ' ')), '{tx.TOKEN}')) AS term FROM ({KEYWORDS})")},
o AS (SELECT b.item_id, b.doc_id, b.score, row_number() OVER (PARTITION BY b.item_id ORDER BY score DESC, b.doc_id) AS rank FROM b JOIN documents d USING (doc_id) WHERE d.source = 'src' || (b.item_id % 20) AND (b.item_id % 2 = 1 OR b.doc_id % 5 = b.item_id % 5)) SELECT item_id, doc_id, score, rank FROM o WHERE rank <= 10"""
)
def fulltext_scoped_year(t: Tables) -> DataFrame:
    """Full-text search with the sanitised query (its keywords), within a scope and, for every other query, a year; ids stand for years."""
    asked = t.benchmark.select("item_id", F.explode(tx.tokens(F.array_join(tx.keywords("text"), " "))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("qtf"))
    # A query of any year asks for each of the five, and its lists are ranked together.
    years = F.when(F.col("item_id") % 2 == 0, F.array(F.col("item_id") % 5)).otherwise(F.array(*[F.lit(y).cast("bigint") for y in range(5)]))
    label = lambda source, year: F.concat_ws("/", source, year.cast("string"))
    wanted = t.benchmark.select("item_id", F.explode(years).alias("year")).withColumn("label", label(F.concat(F.lit("src"), F.col("item_id") % 20), F.col("year")))
    index = t.text_index()
    has = index.table("docs").where("source IS NOT NULL").select("doc_id", label(F.col("source"), F.col("doc_id") % 5).alias("has"))
    j = index.topk(wanted, 10, scope="label", asked=asked.join(wanted.select("item_id", "year"), "item_id"), by=("item_id", "year"), has=has)
    return lexical.ranked(j.select("item_id", "doc_id", "score"), "item_id", "doc_id", 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"SELECT item_id, array_to_string(kw, ' ') AS keywords, len(kw) AS n FROM ({KEYWORDS})")
def keyword_extract(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", tx.keywords("text").alias("kw")).select("item_id", F.array_join("kw", " ").alias("keywords"), F.size("kw").cast("bigint").alias("n"))


@query(
    f"""WITH k AS (SELECT item_id, lower(unnest(kw)) AS term FROM ({KEYWORDS})), s AS (SELECT item_id, doc_id, CAST(sum((length(lt) - length(replace(lt, term, ''))) // length(term)) AS BIGINT) AS score FROM k, (SELECT doc_id, lower(text) AS lt FROM documents) d GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 10"""
)
def count_score_topk(t: Tables) -> DataFrame:
    return lexical.count_topk(t.benchmark, t.spread("documents"), 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"""WITH {BM25}, sq AS (SELECT item_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, CAST(sum(qtf * tf) AS BIGINT) AS score FROM q JOIN tf USING (term) GROUP BY item_id, doc_id)) WHERE rank <= 5),
u AS (SELECT item_id, doc_id, 1 AS list_no, rank FROM br WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, 2, rank FROM sq),
d AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY list_no, rank) AS n FROM u), o AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY list_no, rank) AS pos FROM d WHERE n = 1) SELECT * FROM o WHERE pos <= 15"""
)
def hybrid_merge_topk(t: Tables) -> DataFrame:
    """The first list, then what the second adds, cut to 15."""
    first = t.text_index().topk(t.benchmark, 10).select("item_id", "doc_id", "rank")
    q = lexical.postings(t.benchmark, "item_id").select("item_id", "term", F.col("tf").cast("double").alias("w"))
    raw = t.text_index().best(q, 5, lambda tf, dl: tf)
    return hybrid_merge([first, raw.select("item_id", "doc_id", "rank")], 15)


#: The stand-in embedder in SQL: signed feature hashing of the words of the first 2000 characters, at length 1.
def _embedded_sql(table: str, key: str) -> str:
    return rf"""SELECT {key}, list(x ORDER BY i) AS v FROM (SELECT k.{key}, g.i, coalesce(h.x, 0)::DOUBLE AS x FROM {table} k CROSS JOIN generate_series(0, 63) AS g(i) LEFT JOIN (
SELECT {key}, ('0x' || left(h, 2))::INT % 64 AS i, sum(CASE WHEN ('0x' || substring(h, 15, 2))::INT >= 128 THEN 1 ELSE -1 END) AS x FROM (SELECT {key}, md5(w) AS h FROM (SELECT {key}, unnest(regexp_extract_all(lower(left(text, 2000)), '[^\x09-\x0D\x1C-\x20\x{{85}}\x{{A0}}]+')) AS w FROM {table})) GROUP BY ALL) h ON h.{key} = k.{key} AND h.i = g.i) GROUP BY {key}"""


_UNIT = "list_transform(v, lambda x: x / CASE WHEN list_dot_product(v, v) = 0 THEN 1 ELSE sqrt(list_dot_product(v, v)) END)"
_KINDS = ("bm25", "sparse", "dense")


@query(
    f"""WITH {BM25}, {TFIDF.split(T + ", ", 1)[1]}, de AS (SELECT doc_id, {_UNIT} AS v FROM ({_embedded_sql('documents', 'doc_id')})), qe AS (SELECT item_id, {_UNIT} AS v FROM ({_embedded_sql('benchmark', 'item_id')})),
ds AS (SELECT item_id, doc_id, round(list_dot_product(qe.v, de.v), 6) AS score FROM qe, de), dr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ds),
f AS (SELECT 'bm25' AS backend, item_id, doc_id, score, rank FROM br WHERE rank <= 30 UNION ALL SELECT 'sparse', item_id, doc_id, score, rank FROM sr WHERE rank <= 30 UNION ALL SELECT 'dense', item_id, doc_id, score, rank FROM dr WHERE rank <= 30),
tk AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(left(text, 1500)), '{tx.TOKEN}')) AS d FROM documents), tq AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{tx.TOKEN}')) AS q FROM benchmark),
c AS (SELECT backend, item_id, doc_id, round(len(list_intersect(q, d)) / (len(q) + len(d) - len(list_intersect(q, d)))::DOUBLE, 6) AS score FROM f JOIN tk USING (doc_id) JOIN tq USING (item_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY backend, item_id ORDER BY score DESC, doc_id) AS rank FROM c)
SELECT backend, false AS reranked, item_id, doc_id, score, rank FROM f WHERE rank <= 10 UNION ALL SELECT backend, true, item_id, doc_id, score, rank FROM o WHERE rank <= 10"""
)
def backends_with_and_without_rerank(t: Tables) -> DataFrame:
    """The same questions to three backends behind one interface, each as it is and reranked."""
    docs = t.spread("documents").select("doc_id", "text")
    embedded = embed(docs.withColumnRenamed("doc_id", "id"), "text").select("id", "v", F.lit(None).cast("string").alias("scope"))
    dense_index = vector_index(embedded, "texts-" + source_version(t.documents.select("doc_id", "text")))
    kinds = {"bm25": backends.Lexical(t.text_index()), "sparse": backends.Sparse(docs, t.text_index()), "dense": backends.Dense(dense_index)}
    out = None
    for name, base in kinds.items():
        plain = backends.Kept(base, 30)
        for again in (False, True):
            b = backends.Reranked(plain, docs) if again else plain
            one = b.search(t.benchmark.select("item_id", "text"), 10).select(F.lit(name).alias("backend"), F.lit(again).alias("reranked"), "item_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))
            out = one if out is None else out.unionByName(one)
    return out
