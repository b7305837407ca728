"""Queries on retrieval quality (gold: documents that contain a benchmark text) and on answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import lexical, metrics
from ..operators.sampling import stratified_by_hash
from ..session import settle
from .registry import Tables, query
from .retrieval import BM25

GOLD = "g AS (SELECT b.item_id, d.doc_id, d.source, d.lang FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
RUN = f"{BM25}, {GOLD}, run AS (SELECT br.item_id, br.doc_id, br.score, br.rank, CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM br LEFT JOIN g ON g.item_id = br.item_id AND g.doc_id = br.doc_id)"


def gold(t: Tables) -> DataFrame:
    """(item_id, doc_id, source, lang), searched for once for a query's tables."""
    return t.once("gold", lambda: settle(lexical.holding(t.benchmark, t.spread("documents"), keep=("source", "lang"))))


def of_found(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (doc_id) with what ``docs`` (doc_id) says of theirs: few rows go to the documents, which stay where they are."""
    found = settle(found)
    return lexical.light(found)(found).join(docs, "doc_id")


def run(t: Tables, k: int) -> DataFrame:
    """(item_id, doc_id, score, rank, rel) of BM25."""
    found = settle(t.text_index().topk(t.benchmark, k))
    g = gold(t).select("item_id", "doc_id", F.lit(1).alias("rel"))
    return found.join(g, ["item_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


M1 = """m AS (SELECT item_id, sum(rel) AS n, sum(rel / log2(rank + 1.0)) AS dcg, min(CASE WHEN rel = 1 THEN rank END) AS first FROM run WHERE rank <= 10 GROUP BY item_id),
met AS (SELECT item_id, n / 10.0 AS p, CASE WHEN n > 0 THEN 1 ELSE 0 END AS hit, coalesce(1.0 / first, 0) AS mrr,
 CASE WHEN n > 0 THEN dcg / list_sum(list_transform(generate_series(1, n::BIGINT), lambda i: 1.0 / log2(i + 1.0))) ELSE 0 END AS ndcg FROM m)"""


@query(f"WITH {RUN}, {M1} SELECT item_id, round(p, 6)::DOUBLE AS p, hit, round(mrr, 6)::DOUBLE AS mrr, round(ndcg, 6)::DOUBLE AS ndcg FROM met")
def retrieval_metrics_p_mrr_ndcg(t: Tables) -> DataFrame:
    return metrics.at_k(run(t, 10), "item_id")


@query(
    f"""WITH {RUN}, qr AS (SELECT item_id, doc_id, 1 + doc_id % 2 AS grade FROM g), i AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, doc_id) AS i FROM qr),
d AS (SELECT item_id, sum((power(2, grade) - 1) / log2(i + 1.0)) FILTER (i <= 10) AS idcg, count(*) AS relevant FROM i GROUP BY item_id),
x AS (SELECT run.item_id, sum((power(2, grade) - 1) / log2(rank + 1.0)) AS dcg, min(rank) AS first, count(*) AS n FROM run JOIN qr USING (item_id, doc_id) WHERE rank <= 10 GROUP BY run.item_id)
SELECT item_id, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr, round(coalesce(n / relevant::DOUBLE, 0), 6) AS recall FROM d LEFT JOIN x USING (item_id)"""
)
def graded_ndcg_recall(t: Tables) -> DataFrame:
    qrels = gold(t).select("item_id", "doc_id", (1 + F.col("doc_id") % 2).alias("grade"))
    return metrics.graded_at_k(run(t, 10), qrels, "item_id", "doc_id")


@query(
    f"""WITH {RUN}, c AS (SELECT item_id, count(*) AS golds FROM g GROUP BY item_id), x AS (SELECT item_id, sum(rel) AS n, min(CASE WHEN rel = 1 THEN rank END) AS first FROM run WHERE rank <= 10 GROUP BY item_id)
SELECT count(*) AS queries, round(avg(coalesce(n, 0) / 10.0), 6)::DOUBLE AS p, round(avg(CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS r, round(avg(coalesce(1.0 / first, 0)), 6)::DOUBLE AS mrr, count(*) FILTER (coalesce(n, 0) = 0) AS zero FROM c LEFT JOIN x USING (item_id)"""
)
def gold_document_scores(t: Tables) -> DataFrame:
    """Means over queries that have a gold document."""
    per = run(t, 10).groupBy("item_id").agg(F.sum("rel").alias("n"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    x = gold(t).select("item_id").distinct().join(per, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.agg(
        F.count("*").alias("queries"), F.round(F.avg(F.col("n") / 10.0), 6).alias("p"), F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("r"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.sum((F.col("n") == 0).cast("bigint")).alias("zero"),
    )


SWEEP = """x AS (SELECT item_id, k, max(CASE WHEN rank <= k THEN rel ELSE 0 END) AS hit FROM run, (VALUES (3), (5), (10), (15)) AS ks(k) WHERE rank <= 15 AND item_id IN (SELECT item_id FROM g) GROUP BY item_id, k)"""


def sweep(t: Tables) -> DataFrame:
    r = run(t, 15).join(gold(t).select("item_id").distinct(), "item_id", "left_semi")
    e = r.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (3, 5, 10, 15)])))
    return e.groupBy("item_id", "k").agg(F.max(F.when(F.col("rank") <= F.col("k"), F.col("rel")).otherwise(0)).alias("hit"))


@query(f"WITH {RUN}, {SWEEP} SELECT k, count(*) AS n, round(avg(hit), 6) AS recall FROM x GROUP BY k")
def recall_at_k_sweep(t: Tables) -> DataFrame:
    return sweep(t).groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("recall"))


@query(f"WITH {RUN}, {SWEEP} SELECT item_id, k, hit FROM x")
def hit_at_k(t: Tables) -> DataFrame:
    return sweep(t)


@query(
    f"""WITH {RUN}, {M1}, c AS (SELECT item_id, count(*) AS golds FROM g GROUP BY item_id), n AS (SELECT count(*) AS n FROM documents)
SELECT item_id, round(golds / n.n::DOUBLE, 9) AS chance, round(p / (golds / n.n::DOUBLE), 6) AS lift FROM met JOIN c USING (item_id), n"""
)
def chance_and_lift(t: Tables) -> DataFrame:
    m = metrics.at_k(run(t, 10), "item_id").select("item_id", "p")
    n = t.documents.agg(F.count("*").alias("n"))  # one row
    c = gold(t).groupBy("item_id").agg(F.count("*").alias("golds")).crossJoin(F.broadcast(n))
    chance = F.col("golds") / F.col("n")
    return m.join(c, "item_id").select("item_id", F.round(chance, 9).alias("chance"), F.round(F.col("p") / chance, 6).alias("lift"))


HOME = "home AS (SELECT item_id, min_by(source, doc_id) AS source, min_by(lang, doc_id) AS lang FROM g GROUP BY item_id)"


def home(t: Tables) -> DataFrame:
    """Each query's scope: source and language of its first gold document."""
    return gold(t).groupBy("item_id").agg(F.min_by("source", "doc_id").alias("home"), F.min_by("lang", "doc_id").alias("home_lang"))


def run_sources(t: Tables, k: int = 10) -> DataFrame:
    return of_found(run(t, k), t.documents.select("doc_id", "source", "lang")).join(home(t), "item_id")


@query(f"WITH {RUN}, {HOME} SELECT run.item_id, round(avg((d.source = home.source AND rel = 0)::INT), 6) AS same_scope, round(avg((d.source <> home.source)::INT), 6) AS other_scope FROM run JOIN documents d USING (doc_id) JOIN home ON home.item_id = run.item_id WHERE rank <= 10 GROUP BY run.item_id")
def same_scope_nongold(t: Tables) -> DataFrame:
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    same = F.col("source") == F.col("home")
    return run_sources(t).groupBy("item_id").agg(share(same & (F.col("rel") == 0)).alias("same_scope"), share(~same).alias("other_scope"))


@query(f"WITH {RUN}, tw AS (SELECT DISTINCT g.item_id, o.doc_id FROM g JOIN documents d USING (doc_id) JOIN documents o ON o.text = d.text) SELECT item_id, round(sum(CASE WHEN tw.doc_id IS NULL THEN 0 ELSE 1 END) / 10.0, 6)::DOUBLE AS p_lenient FROM run LEFT JOIN tw USING (item_id, doc_id) WHERE rank <= 10 GROUP BY item_id")
def lenient_precision(t: Tables) -> DataFrame:
    """Copies of a gold document count as gold."""
    # Only what was found or is gold can be a twin of the other: both meet by the hash of their text, within each query.
    both = run(t, 10).select("item_id", "doc_id", F.lit(1).alias("listed")).union(gold(t).select("item_id", "doc_id", F.lit(0)))
    texts = of_found(both, t.documents.select("doc_id", F.sha2("text", 256).alias("h")))
    same = texts.groupBy("item_id", "h").agg(F.sum("listed").alias("n"), F.min("listed").alias("listed"))
    twins = F.when(F.col("listed") == 0, F.col("n")).otherwise(0)
    per = same.groupBy("item_id").agg(F.sum("n").alias("n"), F.round(F.sum(twins) / 10.0, 6).alias("p_lenient"))
    return per.where("n > 0").select("item_id", "p_lenient")


@query(f"WITH {RUN}, {HOME}, c AS (SELECT home.lang AS gold, d.lang AS retrieved, count(*) AS n FROM run JOIN documents d USING (doc_id) JOIN home ON home.item_id = run.item_id WHERE rank <= 10 GROUP BY home.lang, d.lang) SELECT gold, retrieved, n, round(n / sum(n) OVER (PARTITION BY gold), 6) AS share FROM c")
def confusion_matrix(t: Tables) -> DataFrame:
    c = run_sources(t).groupBy(F.col("home_lang").alias("gold"), F.col("lang").alias("retrieved")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("gold")), 6))


@query(f"WITH {RUN}, {HOME}, c AS (SELECT home.lang AS gold, count(*) FILTER (d.lang = home.lang) AS same, count(*) AS n FROM run JOIN documents d USING (doc_id) JOIN home ON home.item_id = run.item_id WHERE rank <= 10 GROUP BY home.lang) SELECT round(avg(same / n), 6) AS diagonal, count(*) AS scopes FROM c")
def confusion_diagonal(t: Tables) -> DataFrame:
    c = run_sources(t).groupBy("home_lang").agg(F.avg((F.col("lang") == F.col("home_lang")).cast("int")).alias("d"))
    return c.agg(F.round(F.avg("d"), 6).alias("diagonal"), F.count("*").alias("scopes"))


ARMS = f"""{RUN}, {HOME}, arm AS (SELECT 'monolithic' AS system, br.item_id, br.doc_id, br.rank, home.lang FROM br JOIN home USING (item_id) WHERE rank <= 10
 UNION ALL SELECT system, item_id, doc_id, rank, lang FROM (SELECT 'by_source' AS system, b.item_id, b.doc_id, home.lang, row_number() OVER (PARTITION BY b.item_id ORDER BY score DESC, b.doc_id) AS rank FROM b JOIN home USING (item_id) JOIN documents d USING (doc_id) WHERE d.source = home.source) WHERE rank <= 10
 UNION ALL SELECT system, item_id, doc_id, rank, lang FROM (SELECT 'by_lang' AS system, b.item_id, b.doc_id, home.lang, row_number() OVER (PARTITION BY b.item_id ORDER BY score DESC, b.doc_id) AS rank FROM b JOIN home USING (item_id) JOIN documents d USING (doc_id) WHERE d.lang = home.lang) WHERE rank <= 10)"""


def arms(t: Tables) -> DataFrame:
    """(system, item_id, doc_id, rank, home, home_lang): one global and two scoped runs of the queries with gold."""
    h = settle(home(t))
    label = lambda kind, c: F.concat(F.lit(f"{kind}/"), c)
    arm = lambda system, want: F.struct(F.lit(system).alias("system"), want.alias("want"))
    three = F.array(arm("monolithic", F.lit(None).cast("string")), arm("by_source", label("source", F.col("home"))), arm("by_lang", label("lang", F.col("home_lang"))))
    # All runs meet the documents at once: one has its source and its language, and a run wants either, or none.
    q = t.benchmark.join(h, "item_id").select("item_id", "text", F.explode(three).alias("arm")).select("item_id", "text", "arm.*")
    q = q.where("want IS NOT NULL OR system = 'monolithic'")
    has = F.array(label("source", F.col("source")), label("lang", F.col("lang")))
    every = t.text_index().topk(q, 10, scope="want", by=("system", "item_id"), has=has, every=True)
    return settle(every.select("system", "item_id", "doc_id", "rank").join(h, "item_id"))


@query(
    f"""WITH {ARMS}, pr AS (SELECT arm.lang AS category, system, item_id, avg((d.lang = arm.lang)::INT) AS p FROM arm JOIN documents d USING (doc_id) GROUP BY arm.lang, system, item_id), m AS (SELECT category, system, avg(p) AS p FROM pr GROUP BY category, system),
w AS (SELECT category, max(p) FILTER (system = 'monolithic') AS mono, max(p) FILTER (system <> 'monolithic') AS best FROM m GROUP BY category) SELECT category, round(mono, 6) AS mono, round(best, 6) AS best, round(1 - mono / nullif(best, 0), 6) AS dilution FROM w"""
)
def dilution_best_scoped(t: Tables) -> DataFrame:
    """One minus the global run's scope precision over that of the best scoped run."""
    d = of_found(arms(t), t.documents.select("doc_id", "lang"))
    p = d.groupBy(F.col("home_lang").alias("category"), "system", "item_id").agg(F.avg((F.col("lang") == F.col("home_lang")).cast("int")).alias("p"))
    m = p.groupBy("category", "system").agg(F.avg("p").alias("p"))
    mono = F.col("system") == "monolithic"
    w = m.groupBy("category").agg(F.max(F.when(mono, F.col("p"))).alias("mono"), F.max(F.when(~mono, F.col("p"))).alias("best"))
    return w.select("category", F.round("mono", 6).alias("mono"), F.round("best", 6).alias("best"), F.round(1 - F.col("mono") / F.nullif("best", F.lit(0.0)), 6).alias("dilution"))


HITS = f"{ARMS}, h AS (SELECT system, item_id, k, max(CASE WHEN rank <= k AND g.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM (SELECT arm.*, k FROM arm, (VALUES (3), (5), (10)) AS ks(k)) a LEFT JOIN g USING (item_id, doc_id) GROUP BY system, item_id, k)"


@query(f"WITH {HITS}, x AS (SELECT item_id, k, max(hit) FILTER (system = 'monolithic') AS mono, coalesce(max(hit) FILTER (system = 'by_source'), max(hit) FILTER (system = 'by_lang')) AS scoped FROM h GROUP BY item_id, k) SELECT item_id, k, scoped - mono AS delta FROM x")
def per_query_delta(t: Tables) -> DataFrame:
    """Hit of the preferred scoped run (by source, else by language) minus that of the global one."""
    g = gold(t).select("item_id", "doc_id", F.lit(1).alias("g"))
    a = arms(t).join(g, ["item_id", "doc_id"], "left").withColumn("k", F.explode(F.array(F.lit(3), F.lit(5), F.lit(10))))
    h = a.groupBy("item_id", "k", "system").agg(F.max(F.when((F.col("rank") <= F.col("k")) & F.col("g").isNotNull(), 1).otherwise(0)).alias("hit"))
    of = lambda s: F.max(F.when(F.col("system") == s, F.col("hit")))
    return h.groupBy("item_id", "k").agg((F.coalesce(of("by_source"), of("by_lang")) - of("monolithic")).alias("delta"))


@query(f"WITH {ARMS} SELECT system, item_id, round(avg((d.source = home.source)::INT), 6) AS scope_precision, max(CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END) AS gold_hit, round(avg(CASE WHEN g.doc_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS gold_precision FROM arm JOIN documents d USING (doc_id) JOIN home USING (item_id) LEFT JOIN g USING (item_id, doc_id) GROUP BY system, item_id")
def scope_precision_gold_hit(t: Tables) -> DataFrame:
    """Per system and query: share of the context in scope, gold in context, gold's share of the context."""
    g = gold(t).select("item_id", "doc_id", F.lit(1).alias("g"))
    a = of_found(arms(t), t.documents.select("doc_id", "source")).join(g, ["item_id", "doc_id"], "left")
    hit = F.col("g").isNotNull().cast("int")
    return a.groupBy("system", "item_id").agg(F.round(F.avg((F.col("source") == F.col("home")).cast("int")), 6).alias("scope_precision"), F.max(hit).alias("gold_hit"), F.round(F.avg(hit), 6).alias("gold_precision"))


@query(
    f"""WITH {ARMS}, s AS (SELECT arm.item_id, system, avg((d.source = home.source)::INT) AS share FROM arm JOIN documents d USING (doc_id) JOIN home USING (item_id) GROUP BY arm.item_id, system),
x AS (SELECT item_id, max(share) FILTER (system = 'monolithic') AS mono, max(share) FILTER (system = 'by_lang') AS other FROM s GROUP BY item_id) SELECT item_id, round(other - mono, 6) AS gap FROM x WHERE other - mono <> 0 ORDER BY gap DESC, item_id LIMIT 20"""
)
def failure_cases(t: Tables) -> DataFrame:
    """A report of the 20 queries whose scope share differs most between two runs."""
    a = of_found(arms(t), t.documents.select("doc_id", "source"))
    s = a.groupBy("item_id", "system").agg(F.avg((F.col("source") == F.col("home")).cast("int")).alias("share"))
    of = lambda x: F.max(F.when(F.col("system") == x, F.col("share")))
    x = s.groupBy("item_id").agg((of("by_lang") - of("monolithic")).alias("d")).where("d <> 0")
    return x.select("item_id", F.round("d", 6).alias("gap")).orderBy(F.desc("gap"), "item_id").limit(20)


LADDER = f"""{RUN}, gc AS (SELECT item_id, min(doc_id) AS chunk FROM g GROUP BY item_id), u AS (SELECT b.item_id, gc.chunk, CASE WHEN b.item_id % 3 <> 0 THEN ' SRC' || (b.item_id % 20) || ' ' END AS title FROM benchmark b LEFT JOIN gc USING (item_id))"""


@query(
    f"""WITH {LADDER}, x AS (SELECT item_id, rank, doc_id, lower(trim(source)) AS source FROM br JOIN documents USING (doc_id) WHERE rank <= 15)
SELECT u.item_id, k, CASE WHEN chunk IS NOT NULL THEN (count(*) FILTER (x.rank <= k AND x.doc_id = chunk) > 0)::INT WHEN title IS NOT NULL THEN (count(*) FILTER (x.rank <= k AND x.source = lower(trim(title))) > 0)::INT END AS hit
FROM u CROSS JOIN (VALUES (3), (5), (10), (15)) AS v(k) LEFT JOIN x ON x.item_id = u.item_id GROUP BY u.item_id, k, chunk, title"""
)
def gold_field_ladder(t: Tables) -> DataFrame:
    """Hits at k by the first gold field that a query has: the gold chunk, else the gold title, else none."""
    chunk = gold(t).groupBy("item_id").agg(F.min("doc_id").alias("gold_id"))
    title = F.when(F.col("item_id") % 3 != 0, F.concat(F.lit(" SRC"), F.col("item_id") % 20, F.lit(" ")))
    asked = t.benchmark.select("item_id", title.alias("gold_title")).join(chunk, "item_id", "left")
    found = of_found(t.text_index().topk(t.benchmark, 15), t.documents.select("doc_id", "source"))
    lists = found.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "source"))).alias("x"))
    j = asked.join(lists, "item_id", "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in (3, 5, 10, 15)])))
    return j.select("item_id", "k", metrics.ladder_hit(F.col("x.doc_id"), F.col("x.source"), F.col("gold_id"), F.col("gold_title"), F.col("k")).alias("hit"))


GROWTH = f"""{RUN}, h AS (SELECT doc_id, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || doc_id), doc_id) AS n FROM documents, (VALUES (1), (2), (3)) AS s(seed) WHERE doc_id NOT IN (SELECT doc_id FROM g)),
ng AS (SELECT count(DISTINCT doc_id) AS ng FROM g), keep AS (SELECT size, seed, doc_id FROM h, ng, (VALUES (100), (400)) AS z(size) WHERE n <= size - ng UNION ALL SELECT size, seed, doc_id FROM (SELECT DISTINCT doc_id FROM g), (VALUES (100), (400)) AS z(size), (VALUES (1), (2), (3)) AS s(seed)),
k AS (SELECT size, seed, b.item_id, b.doc_id, row_number() OVER (PARTITION BY size, seed, b.item_id ORDER BY score DESC, b.doc_id) AS rank FROM b JOIN keep USING (doc_id)),
p AS (SELECT size, seed, k.item_id, count(g.doc_id) / 10.0 AS p, max(CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END) AS hit FROM k LEFT JOIN g ON g.item_id = k.item_id AND g.doc_id = k.doc_id WHERE rank <= 10 GROUP BY size, seed, k.item_id),
m AS (SELECT size, seed, avg(p) AS p, avg(hit) AS hit FROM p GROUP BY size, seed)"""


def keep_sets(t: Tables, sizes: tuple[int, ...] = (100, 400), seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(size, seed, doc_id): all gold documents, filled up with others in the order of a seeded hash."""
    pinned = gold(t).select("doc_id").distinct()
    others = t.documents.select("doc_id").join(pinned, "doc_id", "left_anti")
    n = pinned.count()
    # One pass draws all seeds; a smaller set is the beginning of a larger one of its seed.
    drawn = others.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    w = Window.partitionBy("seed").orderBy(F.md5(F.concat_ws(":", "seed", "doc_id")), "doc_id")
    place = drawn.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(max(sizes) - n, 0))
    size = F.explode(F.array(*[F.lit(z) for z in sizes])).alias("size")
    filled = place.select(size, "seed", "doc_id", "n").where(F.col("n") <= F.col("size") - n).select("size", "seed", "doc_id")
    return filled.union(pinned.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).select(size, "seed", "doc_id"))


@query(f"WITH {GROWTH} SELECT size, seed, count(*) AS docs FROM keep GROUP BY size, seed")
def pinned_subset_hash(t: Tables) -> DataFrame:
    return keep_sets(t).groupBy("size", "seed").agg(F.count("*").alias("docs"))


#: As ``GROWTH``, for sets of 100, 400, 1,600 and so on, and for all documents.
GROWTH_TO_ALL = (
    GROWTH.replace(", h AS (", ", z AS (SELECT size FROM (SELECT 100 * power(4, i)::BIGINT AS size FROM generate_series(0, 25) AS s(i)), (SELECT count(*) AS n FROM documents) WHERE size < n UNION ALL SELECT count(*) FROM documents), h AS (", 1)
    .replace("(VALUES (100), (400)) AS z(size)", "z")
)


def grown(t: Tables, seeds: tuple[int, ...] = (1, 2, 3)) -> tuple[list[int], DataFrame, Column]:
    """Sizes of growing sets up to all documents, and the names seed/i of the smallest set of each seed that a document is
    in: (doc_id, has) for gold documents, which are in all sets, and an expression for the others, by a seeded hash."""
    total = t.documents.count()
    sizes = [z for z in (100 * 4**i for i in range(26)) if z < total] + [total]
    pinned = settle(gold(t).select("doc_id").distinct())
    n = pinned.count()
    key = lambda s: F.md5(F.concat_ws(":", s, "doc_id"))
    others = t.documents.select("doc_id").join(lexical.light(pinned)(pinned), "doc_id", "left_anti")
    drawn = others.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn("key", key("seed")).withColumn("bin", F.substring("key", 1, 3))
    # The last document of a set is found by counts: at most 4,096 bins a seed, then the places within its bin.
    counts = sorted((r.seed, r.bin, r.n) for r in drawn.groupBy("seed", "bin").agg(F.count("*").alias("n")).collect())
    sought: dict[tuple, list[int]] = {}
    for s in seeds:
        for i, z in enumerate(sizes[:-1]):
            left = z - n
            for seed, bin_, m in counts:
                if seed == s and left > 0:
                    if left <= m:
                        sought[s, bin_, left] = [*sought.get((s, bin_, left), []), i]
                    left -= m
    bounds = []
    if sought:
        bins = F.concat_ws("/", F.col("seed").cast("string"), F.col("bin"))
        w = Window.partitionBy("seed", "bin").orderBy("key", "doc_id")
        placed = drawn.where(bins.isin(sorted({f"{s}/{b}" for s, b, _ in sought}))).withColumn("n", F.row_number().over(w))
        at = placed.where(F.concat_ws("/", bins, F.col("n").cast("string")).isin([f"{s}/{b}/{m}" for s, b, m in sought])).collect()
        bounds = sorted((i, r.seed, r.key, r.doc_id) for r in at for i in sought[r.seed, r.bin, r.n])
    name = lambda s, i: F.lit(f"{s}/{i}")

    def smallest(s: int) -> Column:
        own = key(F.lit(s))
        return F.coalesce(*[F.when((own < k) | ((own == k) & (F.col("doc_id") <= d)), name(s, i)) for i, seed, k, d in bounds if seed == s], name(s, len(sizes) - 1))

    return sizes, pinned.withColumn("has", F.array(*[name(s, 0) for s in seeds])), F.array(*[smallest(s) for s in seeds])


@query(f"WITH {GROWTH_TO_ALL} SELECT size, round(avg(p), 6)::DOUBLE AS p, round(stddev_samp(p), 6) AS sd_p, round(avg(hit), 6) AS hit FROM m GROUP BY size")
def corpus_growth_curve(t: Tables) -> DataFrame:
    """Precision at 10 as the corpus grows to its whole: mean over seeds of means over queries, and the seeds' standard deviation."""
    seeds = (1, 2, 3)
    sizes, has, rest = grown(t, seeds)
    # A document is asked for in the smallest of its sets only; the best of a set are among the best of what each smaller one adds.
    sets = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(i).alias("i"), F.lit(f"{s}/{i}").alias("set")) for s in seeds for i in range(len(sizes))])
    asked = t.benchmark.select("item_id", "text", F.explode(sets).alias("x")).select("item_id", "text", "x.*")
    top = t.text_index().topk(asked, 10, scope="set", by=("item_id", "seed", "i"), has=has, rest=rest).drop("rank")
    within = F.array(*[F.struct(F.lit(i).alias("j"), F.lit(z).cast("bigint").alias("size")) for i, z in enumerate(sizes)])
    every = top.withColumn("z", F.explode(within)).where("i <= z.j").withColumn("size", F.col("z.size"))
    w = Window.partitionBy("size", "seed", "item_id").orderBy(F.desc("score"), "doc_id")
    every = every.withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    g = gold(t).select("item_id", "doc_id", F.lit(1).alias("g"))
    per = every.join(g, ["item_id", "doc_id"], "left").groupBy("size", "seed", "item_id").agg((F.count("g") / 10.0).alias("p"), F.max(F.col("g").isNotNull().cast("int")).alias("hit"))
    means = per.groupBy("size", "seed").agg(F.avg("p").alias("p"), F.avg("hit").alias("hit"))
    return means.groupBy("size").agg(F.round(F.avg("p"), 6).alias("p"), F.round(F.stddev_samp("p"), 6).alias("sd_p"), F.round(F.avg("hit"), 6).alias("hit"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS n, count(*) OVER (PARTITION BY source) AS ns, count(*) OVER () AS total FROM documents) WHERE n <= greatest(1, round(80 * ns / total))")
def stratified_sample_hash(t: Tables) -> DataFrame:
    return stratified_by_hash(t.documents.select("source", "doc_id"), 80, "source", "doc_id", "7")


PAIRS = "pr AS (SELECT u.conv_id, u.turn, u.text AS gold, a.text AS pred FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


def _norm(c: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the')), ' ')"


NORM = f"{PAIRS}, nm AS (SELECT conv_id, turn, {_norm('gold')} AS g, {_norm('pred')} AS p FROM pr)"


def answers(t: Tables) -> DataFrame:
    """A user turn as the gold text of the assistant turn after it."""
    c = t.conversations
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("gold"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return u.join(a, ["conv_id", "turn"])


@query(f"WITH {NORM} SELECT conv_id, turn, (g = p)::INT AS em FROM nm")
def qa_exact_match(t: Tables) -> DataFrame:
    return answers(t).select("conv_id", "turn", metrics.exact_match(F.col("pred"), F.col("gold")).alias("em"))


@query(f"WITH {NORM} SELECT conv_id, turn, CASE WHEN g = '' THEN 0 ELSE contains(p, g)::INT END AS hit FROM nm")
def qa_contains(t: Tables) -> DataFrame:
    return answers(t).select("conv_id", "turn", metrics.contains_answer(F.col("pred"), F.col("gold")).alias("hit"))


@query(f"WITH {NORM} SELECT conv_id, turn, CASE WHEN g = '' THEN 0 WHEN len(string_split(g, ' ')) > 20 THEN contains(p, g)::INT ELSE contains(' ' || p || ' ', ' ' || g || ' ')::INT END AS em FROM nm")
def qa_window_em(t: Tables) -> DataFrame:
    return answers(t).select("conv_id", "turn", metrics.window_match(F.col("pred"), F.col("gold")).alias("em"))


@query(
    f"""WITH {NORM}, pw AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(p, ' ')) AS w FROM nm) WHERE w <> '' GROUP BY ALL), gw AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(g, ' ')) AS w FROM nm) WHERE w <> '' GROUP BY ALL),
c AS (SELECT conv_id, turn, sum(least(pw.n, gw.n))::DOUBLE AS c FROM pw JOIN gw USING (conv_id, turn, w) GROUP BY conv_id, turn), np AS (SELECT conv_id, turn, sum(n) AS np FROM pw GROUP BY ALL), ng AS (SELECT conv_id, turn, sum(n) AS ng FROM gw GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN np IS NULL OR ng IS NULL THEN (coalesce(np, 0) = coalesce(ng, 0))::INT::DOUBLE WHEN coalesce(c, 0) = 0 THEN 0 ELSE round(2 * (c / np) * (c / ng) / (c / np + c / ng), 6) END AS f1 FROM nm LEFT JOIN c USING (conv_id, turn) LEFT JOIN np USING (conv_id, turn) LEFT JOIN ng USING (conv_id, turn)"""
)
def qa_token_f1(t: Tables) -> DataFrame:
    return metrics.token_f1(answers(t), ["conv_id", "turn"], "pred", "gold")
