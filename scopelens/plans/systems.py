"""Queries on routing, answering systems, parsing of model output, clustering, and the theory of dilution."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import text as tx
from ..functions.vector import doubles, dot, mean_pool
from ..operators import clustering, dense, lexical, systems
from ..operators import statistics as st
from ..operators.joins import choose_by_threshold
from ..operators.sampling import draw, draw_key
from ..session import settle
from .corpus import TOPICS, _topic_sql
from .registry import Tables, query
from .retrieval import BM25, CENTROIDS, KNN, SCOPED, E, as_queries, neighbours, route, vectors

#: Terms of the routing classifier: a parameter of the model, as its layers would be.
VOCABULARY = 1 << 18

# --- routing policies and systems


@query(f"WITH {BM25} SELECT item_id, doc_id, rank FROM br WHERE rank <= 15")
def monolithic_system(t: Tables) -> DataFrame:
    return t.text_index().topk(t.benchmark, 15).select("item_id", "doc_id", F.col("rank").cast("bigint"))


def routed_search(t: Tables, routes: DataFrame) -> DataFrame:
    """(item_id, doc_id, score, rank): 15 of the documents whose topic is the query's route (item_id, route); of all by the route general."""
    q = t.benchmark.join(routes.select("item_id", F.nullif("route", F.lit("general")).alias("route")), "item_id")
    return t.text_index().topk(q, 15, scope="route", has="topic", every=True)


ROUTED = f"rt AS (SELECT item_id, {_topic_sql('text')} AS route FROM benchmark), dt AS (SELECT doc_id, {_topic_sql('text')} AS topic FROM documents)"


@query(
    f"""WITH {BM25}, {ROUTED}, s AS (SELECT b.item_id, b.doc_id, rt.route, row_number() OVER (PARTITION BY b.item_id ORDER BY score DESC, b.doc_id) AS rank FROM b JOIN rt USING (item_id) JOIN dt USING (doc_id) WHERE rt.route = 'general' OR rt.route = dt.topic) SELECT item_id, route, doc_id, rank FROM s WHERE rank <= 15"""
)
def regex_scoped_system(t: Tables) -> DataFrame:
    """The first rule that matches a query names its scope; queries without one see all documents."""
    q = t.benchmark.withColumn("route", tx.first_match(F.col("text"), TOPICS, "general"))
    found = routed_search(t, q.select("item_id", "route"))
    return found.join(q.select("item_id", "route"), "item_id").select("item_id", "route", "doc_id", F.col("rank").cast("bigint"))


REGEX = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{v}'" for p, v in TOPICS[:3]) + " END"


@query(
    f"""WITH {BM25}, a AS (SELECT item_id, {REGEX} AS regex, lower(list_last(string_split(trim(text), chr(10)))) AS answer FROM benchmark),
rt AS (SELECT item_id, CASE WHEN regex IS NOT NULL THEN 'regex' ELSE 'llm' END AS decision, coalesce(regex, CASE WHEN answer IN ('common', 'licence', 'numbers', 'table') THEN answer WHEN contains(answer, 'licence') THEN 'licence' WHEN contains(answer, 'numbers') THEN 'numbers' WHEN contains(answer, 'common') THEN 'common' WHEN contains(answer, 'table') THEN 'table' WHEN contains(answer, 'th') THEN 'common' ELSE 'general' END) AS route FROM a),
dt AS (SELECT doc_id, {_topic_sql('text')} AS topic FROM documents),
s AS (SELECT b.item_id, b.doc_id, rt.route, rt.decision, row_number() OVER (PARTITION BY b.item_id ORDER BY score DESC, b.doc_id) AS rank FROM b JOIN rt USING (item_id) JOIN dt USING (doc_id) WHERE rt.route = 'general' OR rt.route = dt.topic) SELECT item_id, decision, route, doc_id, rank FROM s WHERE rank <= 15"""
)
def hybrid_routed_system(t: Tables) -> DataFrame:
    """Rules first; queries that no rule matches ask a model, whose answer is parsed against the catalog; then scoped search.

    The model is a stand-in that answers with the prompt's last line; ``th`` in an answer stands for the scope common.
    """
    q = t.benchmark.select("item_id", "text", tx.first_match(F.col("text"), TOPICS[:3]).alias("regex"))
    asked = systems.generate(q.where("regex IS NULL").select("item_id", "text"), "text")
    named = parsing.named_route(F.col("answer"), sorted(v for _, v in TOPICS), default="")
    llm = F.when(named != "", named).when(F.lower("answer").contains("th"), "common").otherwise("general")
    routed = asked.select("item_id", F.lit("llm").alias("decision"), llm.alias("route")).union(q.where("regex IS NOT NULL").select("item_id", F.lit("regex"), "regex"))
    routed = settle(routed)
    return routed_search(t, routed).join(routed, "item_id").select("item_id", "decision", "route", "doc_id", F.col("rank").cast("bigint"))


@query(f"WITH {SCOPED} SELECT qid, l::VARCHAR AS scope, id, srank AS rank FROM p WHERE l = ql AND srank <= 15 AND ql <> 0 UNION ALL SELECT qid, 'global', id, rank FROM r WHERE ql = 0 AND rank <= 15")
def oracle_scoped_system(t: Tables) -> DataFrame:
    """The true scope is searched; the catch-all scope 0 means all."""
    v = vectors(t).withColumn("scope", F.col("label").cast("string"))
    q = v.select(F.col("id").alias("qid"), "v", F.when(F.col("label") != 0, F.col("scope")).alias("scope")).withColumn("list", F.coalesce("scope", F.lit("global")))
    return dense.topk(q, v, 15, exclude_self=True).select("qid", F.col("list").alias("scope"), "id", F.col("rank").cast("bigint"))


@query()
def trained_routed_system(t: Tables) -> DataFrame:
    """A linear probe that was fitted on the other half routes each vector, with its confidence; the scope it names is searched."""
    v = vectors(t).withColumn("x", array_to_vector("v")).withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2)))
    probe = LogisticRegression(featuresCol="x", labelCol="label", maxIter=20, regParam=0.1)
    one, two = (probe.fit(v.where(F.col("half") != k)).transform(v.where(F.col("half") == k)) for k in (0, 1))
    p = one.union(two).select("id", "v", F.col("prediction").cast("int").cast("string").alias("scope"), F.round(F.array_max(vector_to_array("probability")), 6).alias("confidence"))
    corpus = v.withColumn("scope", F.col("label").cast("string"))
    found = dense.topk(p.withColumnRenamed("id", "qid"), corpus, 15, exclude_self=True)
    return found.join(p.select(F.col("id").alias("qid"), "scope", "confidence"), "qid").select("qid", "scope", "confidence", "id", "rank")


@query(
    f"""WITH {SCOPED}, plan AS (SELECT vec_id AS qid, s AS scope, CASE WHEN s = label % 10 THEN 0 ELSE 1 END AS hop FROM e, generate_series(0, 9) AS g(s) WHERE s IN (label, (label + 3) % 10)),
c AS (SELECT p.qid, p.id, min({{'hop': plan.hop, 'rank': p.srank}}) AS pl FROM p JOIN plan ON plan.qid = p.qid AND plan.scope = p.l WHERE p.srank <= 5 GROUP BY p.qid, p.id) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY pl, id) AS pos FROM c"""
)
def single_call_plan(t: Tables) -> DataFrame:
    """A plan of two scoped sub-queries per query runs as one batch; results are united in plan order."""
    corpus = vectors(t).withColumn("scope", F.col("label").cast("string"))
    v = as_queries(vectors(t))
    hop = lambda shift, name: v.select("qid", "v", ((F.col("ql") + shift) % 10).cast("string").alias("scope"), F.lit(name).alias("list"))
    found = dense.topk(hop(0, "0").unionByName(hop(3, "1")), corpus, 5, exclude_self=True)
    return systems.union_hops([found.where("list = '0'"), found.where("list = '1'")])


def _hop_sql(i: int) -> str:
    return f"""s{i} AS (SELECT q.qid, e.vec_id AS id, round(list_dot_product(q.v, e.v), 6) AS sim FROM q{i} q JOIN e ON e.vec_id <> q.qid), r{i} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM s{i}),
q{i + 1} AS (SELECT q.qid, list_transform(list_zip(q.v, e.v), lambda p: (p[1] + p[2]) / 2) AS v FROM q{i} q JOIN r{i} r ON r.qid = q.qid AND r.rank = 1 JOIN e ON e.vec_id = r.id)"""


HOPS = f"{E}, q0 AS (SELECT vec_id AS qid, v FROM e), {_hop_sql(0)}, {_hop_sql(1)}, {_hop_sql(2)}"


@query(
    f"""WITH {HOPS}, u AS (SELECT qid, id, 0 AS hop, rank FROM r0 WHERE rank <= 5 UNION ALL SELECT qid, id, 1, rank FROM r1 WHERE rank <= 5 UNION ALL SELECT qid, id, 2, rank FROM r2 WHERE rank <= 5),
f AS (SELECT qid, id, min(hop * 10 + rank) AS place FROM u GROUP BY qid, id) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place, id) AS pos FROM f"""
)
def multi_hop_orchestrator(t: Tables) -> DataFrame:
    v = vectors(t)
    return systems.multi_hop(lambda q: dense.topk(q, v, 5, exclude_self=True), as_queries(v).select("qid", "v"), v, hops=3)


@query(
    f"""WITH {SCOPED}, tier AS (SELECT vec_id AS qid, s AS l, CASE WHEN s = label THEN 20 WHEN s = (label + 1) % 10 THEN 5 ELSE 0 END AS depth FROM e, generate_series(0, 9) AS g(s)) SELECT p.qid, p.l::VARCHAR AS scope, p.id, p.srank AS rank FROM p JOIN tier USING (qid, l) WHERE p.srank <= depth"""
)
def tiered_depth_retrieval(t: Tables) -> DataFrame:
    """Relevant scopes are read to depth 20, doubtful ones to 5."""
    corpus = vectors(t).withColumn("scope", F.col("label").cast("string"))
    v = as_queries(vectors(t))
    tier = lambda shift, depth: v.select("qid", ((F.col("ql") + shift) % 10).cast("string").alias("scope"), F.lit(depth).alias("depth"))
    tiers = tier(0, 20).union(tier(1, 5))
    q = v.select("qid", "v").join(tiers, "qid").withColumn("list", F.col("scope")).drop("depth")
    found = dense.topk(q, corpus, 20, exclude_self=True).withColumn("scope", F.col("list"))
    return systems.tiered(found.select("qid", "scope", "id", F.col("rank").cast("bigint").alias("rank")), tiers)


@query(
    f"""WITH {BM25}, tk AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(left(text, 1500)), '{tx.TOKEN}')) AS d FROM documents), tq AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{tx.TOKEN}')) AS q FROM benchmark),
c AS (SELECT item_id, doc_id, round(len(list_intersect(q, d)) / (len(q) + len(d) - len(list_intersect(q, d)))::DOUBLE, 6) AS score FROM br JOIN tk USING (doc_id) JOIN tq USING (item_id) WHERE rank <= 30),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c) SELECT item_id, doc_id, score, rank FROM o WHERE rank <= 10"""
)
def cross_encoder_rerank(t: Tables) -> DataFrame:
    """Thirty candidates rescored by a pluggable pair score (here: word overlap with the text's first 1500 characters), ten kept."""
    found = settle(t.text_index().topk(t.benchmark, 30))
    # The documents' beginnings become words once they are few.
    near = lexical.light(found)(found).join(t.documents.select("doc_id", F.substring("text", 1, 1500).alias("s")), "doc_id")
    j = near.select("item_id", "doc_id", tx.tokens("s").alias("d")).join(t.benchmark.select("item_id", tx.tokens("text").alias("q")), "item_id")
    score = F.size(F.array_intersect("q", "d")) / F.size(F.array_union("q", "d"))
    return lexical.ranked(j.select("item_id", "doc_id", F.round(score, 6).alias("score")), "item_id", "doc_id", 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"""WITH RECURSIVE {KNN}, k AS (SELECT qid, 0::BIGINT AS rank, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT qid FROM r)
UNION ALL SELECT k.qid, k.rank + 1, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.qid = r.id AND list_contains(k.kept, s.id) AND s.sim > 0.5) THEN k.kept ELSE list_append(k.kept, r.id) END FROM k JOIN r ON r.qid = k.qid AND r.rank = k.rank + 1 WHERE k.rank < 10)
SELECT r.qid, r.id, r.rank FROM r JOIN (SELECT qid, unnest(kept) AS id FROM k WHERE rank = 10) USING (qid, id)"""
)
def greedy_near_dup_suppression(t: Tables) -> DataFrame:
    """Of each query's ten nearest those that no nearer kept one resembles."""
    nb = neighbours(t, 10).select("qid", "id", F.col("rank").cast("bigint").alias("rank"))
    return systems.suppress_near_duplicates(nb.join(vectors(t).select("id", "v"), "id"), 0.5)


@query(
    f"""WITH {BM25}, p AS (SELECT item_id, string_agg(text, chr(10) ORDER BY rank) AS prompt FROM br JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY item_id)
SELECT item_id, length(list_last(string_split(regexp_replace(prompt, '\\s+$', ''), chr(10)))) AS chars, NULL::VARCHAR AS error FROM p"""
)
def stub_answers(t: Tables) -> DataFrame:
    """Context, prompt and pluggable generation, end to end with the stand-in model, which answers with the last line."""
    found = settle(t.text_index().topk(t.benchmark, 3))
    ctx = lexical.light(found)(found).join(t.documents.select("doc_id", F.col("text").alias("s")), "doc_id")
    p = ctx.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "s"))).alias("x")).select("item_id", F.array_join(F.col("x.s"), "\n").alias("prompt"))
    return systems.generate(p, "prompt").select("item_id", F.length("answer").cast("bigint").alias("chars"), "error")


# --- parsing of model output

#: Every run's reply: a judgement, a tool call or neither (a), and a reasoning step or a route (b).
RAW = """raw AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'Sure. {"correctness": ' || (event_id % 3) || ', "reason": "' || event_type || '"} done' WHEN 1 THEN 'no json in {"correctness": "' || event_type || '"}'
WHEN 2 THEN '[{"claim": "a", "supported": ' || (event_id % 3 % 2) || '}, {"claim": "' || event_type || '", "supported":1}]' ELSE '<tool_call>{"name": "' || event_type || '", "arguments": ' || props || '}</tool_call> text <tool_call>oops</tool_call>' END AS a,
CASE event_id % 3 WHEN 0 THEN 'Action: ' || event_type || chr(10) || 'Action Input: {"query": "' || event_type || ' ' || user_id || '"}' WHEN 1 THEN 'Action: lookup' || chr(10) || 'Action Input: plain ' || event_id ELSE CASE WHEN user_id % 2 = 0 THEN 'I would ask ' ELSE '' END || event_type || chr(10) || 'because' END AS b FROM events)"""


def replies(t: Tables) -> DataFrame:
    text, id_ = lambda s: F.lit(s), F.col("event_id")
    kind = F.col("event_type")
    a = (
        F.when(id_ % 4 == 0, F.concat(text('Sure. {"correctness": '), id_ % 3, text(', "reason": "'), kind, text('"} done')))
        .when(id_ % 4 == 1, F.concat(text('no json in {"correctness": "'), kind, text('"}')))
        .when(id_ % 4 == 2, F.concat(text('[{"claim": "a", "supported": '), id_ % 3 % 2, text('}, {"claim": "'), kind, text('", "supported":1}]')))
        .otherwise(F.concat(text('<tool_call>{"name": "'), kind, text('", "arguments": '), "props", text("}</tool_call> text <tool_call>oops</tool_call>")))
    )
    b = (
        F.when(id_ % 3 == 0, F.concat(text("Action: "), kind, text('\nAction Input: {"query": "'), kind, text(" "), "user_id", text('"}')))
        .when(id_ % 3 == 1, F.concat(text("Action: lookup\nAction Input: plain "), id_))
        .otherwise(F.concat(F.when(F.col("user_id") % 2 == 0, "I would ask ").otherwise(""), kind, text("\nbecause")))
    )
    return t.events.select(id_.alias("id"), a.alias("a"), b.alias("b"))


@query(f"WITH {RAW}, o AS (SELECT id, regexp_extract(a, '(\\{{[^{{}}]*\\}})', 1) AS j FROM raw) SELECT id, coalesce(CASE WHEN json_valid(nullif(j, '')) THEN TRY_CAST(json_extract_string(nullif(j, ''), '$.correctness') AS INT) END, 0) AS correctness FROM o")
def json_salvage(t: Tables) -> DataFrame:
    return replies(t).select("id", parsing.verdict(F.col("a"), "correctness").alias("correctness"))


@query(f"WITH {RAW}, h AS (SELECT id, regexp_extract_all(a, '\"supported\"\\s*:\\s*([01])', 1) AS s FROM raw) SELECT id, CASE WHEN len(s) > 0 THEN round(len(list_filter(s, lambda x: x = '1')) / len(s), 6) END AS faithfulness FROM h")
def claim_fraction(t: Tables) -> DataFrame:
    return replies(t).select("id", F.round(parsing.claim_fraction(F.col("a")), 6).alias("faithfulness"))


@query(f"WITH {RAW}, h AS (SELECT id, unnest(regexp_extract_all(a, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', 1)) AS b FROM raw) SELECT id, json_extract_string(b, '$.name') AS name, json_extract(b, '$.arguments')::VARCHAR AS arguments FROM h WHERE json_valid(b) AND json_extract_string(b, '$.name') IS NOT NULL")
def tool_call_parse(t: Tables) -> DataFrame:
    c = replies(t).select("id", F.explode(parsing.tool_calls(F.col("a"))).alias("c"))
    return c.select("id", "c.name", "c.arguments")


@query(f"WITH {RAW}, h AS (SELECT id, regexp_extract(b, '(?m)^Action:\\s*([A-Za-z_]+)\\s*$', 1) AS tool, regexp_extract(b, '(?m)^Action Input:\\s*(.*)$', 1) AS arg FROM raw) SELECT id, tool, coalesce(CASE WHEN json_valid(arg) THEN json_extract_string(arg, '$.query') END, arg) AS input FROM h WHERE tool <> ''")
def react_action_parse(t: Tables) -> DataFrame:
    return replies(t).select("id", parsing.action(F.col("b")).alias("x")).where("x IS NOT NULL").select("id", "x.tool", "x.input")


@query(f"WITH {RAW}, h AS (SELECT id, b, lower(trim(split_part(b, chr(10), 1))) AS line FROM raw) SELECT id, CASE WHEN line IN ('click', 'purchase', 'view') THEN line WHEN contains(lower(b), 'purchase') THEN 'purchase' WHEN contains(lower(b), 'click') THEN 'click' WHEN contains(lower(b), 'view') THEN 'view' ELSE 'general' END AS route FROM h")
def llm_route_parse(t: Tables) -> DataFrame:
    return replies(t).select("id", parsing.named_route(F.col("b"), ["click", "purchase", "view"]).alias("route"))


TAXONOMY = ("en", "de", "es", "fr", "licence", "abuse", "table of numbers", "numbers", "common")


class Librarian:
    """A stand-in classifier: it quotes the document's last five words, then sometimes a line of its own."""

    def generate(self, prompts: list[str]) -> list[str]:
        return ["It ends in: " + " ".join(p.split()[-5:]) + ("\nI would say Numbers." if len(p) % 3 == 0 else "") for p in prompts]


SAID = """a AS (SELECT doc_id, source, list_filter(string_split_regex(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' +'), lambda w: w <> '') AS w, length(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, source, lower('It ends in: ' || array_to_string(w[-5:], ' ') || CASE WHEN n % 3 = 0 THEN chr(10) || 'I would say Numbers.' ELSE '' END) AS said FROM a)"""
FIRST_NAME = "CASE " + " ".join(f"WHEN contains(said, '{n}') THEN '{n}'" for n in TAXONOMY) + " ELSE source END"


@query(f"WITH {SAID} SELECT doc_id, {FIRST_NAME} AS label FROM s")
def document_classifier_parse(t: Tables) -> DataFrame:
    """A model names each document's class; the first taxonomy name that its answer contains counts, else the old label."""
    told = systems.generate(t.spread("documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")), "text", Librarian)
    return told.select("doc_id", parsing.first_name(F.col("answer"), TAXONOMY, F.col("source")).alias("label"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) AS k, CASE WHEN json_extract_string(props, '$.answer') IS NOT NULL THEN 'inner' WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 'step' ELSE 'refusal' END AS origin FROM events")
def answer_blob_repair(t: Tables) -> DataFrame:
    """Inner JSON first, then what steps left, then a refusal."""
    k = F.get_json_object("props", "$.k")
    origin = F.when(F.get_json_object("props", "$.answer").isNotNull(), "inner").when(k.isNotNull(), "step").otherwise("refusal")
    return t.events.select("event_id", F.coalesce(k.try_cast("int"), F.lit(-1)).alias("k"), origin.alias("origin"))


@query("SELECT conv_id, turn, unnest(CASE turn % 3 WHEN 0 THEN [role, turn::VARCHAR] ELSE [role] END) AS item FROM conversations")
def literal_list_parse(t: Tables) -> DataFrame:
    """Lists written by hand, as Python or JSON, or a plain word, back to their items."""
    role, turn = F.col("role"), F.col("turn")
    s = F.when(turn % 3 == 0, F.concat(F.lit("['"), role, F.lit("', '"), turn, F.lit("']"))).when(turn % 3 == 1, role).otherwise(F.concat(F.lit('["'), role, F.lit('"]')))
    return t.conversations.select("conv_id", "turn", F.explode(parsing.literal_list(s)).alias("item"))


@query("SELECT source, item_id FROM (SELECT d.source, b.item_id, row_number() OVER (PARTITION BY d.source ORDER BY md5('q:' || b.item_id), b.item_id) AS n FROM benchmark b JOIN documents d ON d.doc_id = b.item_id) WHERE n <= 3")
def query_generation_plan(t: Tables) -> DataFrame:
    """Up to three prompts per source in hash order, oversampled before validity is checked elsewhere."""
    j = t.benchmark.join(t.documents.select(F.col("doc_id").alias("item_id"), "source"), "item_id")
    w = Window.partitionBy("source").orderBy(draw_key("item_id", "q"), "item_id")
    return j.withColumn("n", F.row_number().over(w)).where("n <= 3").select("source", "item_id")


# --- clustering and classification


def with_vector(t: Tables) -> DataFrame:
    return vectors(t).withColumn("x", array_to_vector("v"))


def clusters(t: Tables, k: int, seed: int = 42) -> DataFrame:
    v = with_vector(t)
    return KMeans(featuresCol="x", k=k, seed=seed, maxIter=20).fit(v).transform(v).select("id", "v", "x", "label", F.col("prediction").alias("cluster"))


@query()
def kmeans_scopes(t: Tables) -> DataFrame:
    """Discovered scopes and how they agree with the labels."""
    c = clusters(t, 8).groupBy(F.col("label").alias("a"), F.col("cluster").alias("b")).agg(F.count("*").alias("n"))
    return st.agreement(c)


@query()
def granularity_sweep(t: Tables) -> DataFrame:
    """Per k: silhouette (cosine), Calinski-Harabasz and agreement with two labellings; the finest k gives the verdict."""
    v = with_vector(t)
    n = v.count()
    centre = mean_pool(v.withColumn("all", F.lit(0)), ["all"], "v", normalise=False).first().v
    rows = []
    for k in (4, 8, 12):
        model = KMeans(featuresCol="x", k=k, seed=42, maxIter=20).fit(v)
        p = model.transform(v)
        sil = ClusteringEvaluator(featuresCol="x", predictionCol="prediction", distanceMeasure="cosine").evaluate(p)
        sizes = {r.prediction: r["count"] for r in p.groupBy("prediction").count().collect()}
        between = sum(m * float(((np.asarray(c) - centre) ** 2).sum()) for i, c in enumerate(model.clusterCenters()) if (m := sizes.get(i, 0)))
        ch = (between / (k - 1)) / (model.summary.trainingCost / (n - k))
        nmi = [st.agreement(p.groupBy(a.alias("a"), F.col("prediction").alias("b")).agg(F.count("*").alias("n"))).first().nmi for a in (F.col("label"), F.col("label") % 2)]
        rows.append((k, float(sil), float(ch), float(nmi[0]), float(nmi[1])))
    fine = rows[-1]
    verdict = "fine" if fine[3] > fine[4] + 0.05 else "coarse"
    return t.spark.createDataFrame([(*r, verdict) for r in rows], "k int, silhouette double, calinski_harabasz double, nmi_label double, nmi_parity double, verdict string")


@query()
def minibatch_granularity(t: Tables) -> DataFrame:
    """Mini-batch k-means over a grid of k: cost and agreement with two labellings by k, which k agrees best with the
    labels, and whether the finest one follows the labels or the coarser axis."""
    v = vectors(t)
    models = clustering.minibatch_kmeans(v, clustering.spaced(4, 12, 5))
    a = settle(clustering.assigned(v, models).select("k", "cluster", "label", "distance"))
    cost = a.groupBy("k").agg(F.sum("distance").alias("inertia"))
    axes = F.explode(F.array(F.struct(F.lit("label").alias("axis"), F.col("label").alias("a")), F.struct(F.lit("parity").alias("axis"), (F.col("label") % 2).alias("a")))).alias("x")
    counts = a.select("k", "cluster", axes).groupBy("k", "x.axis", F.col("x.a").alias("a"), F.col("cluster").alias("b")).agg(F.count("*").alias("n"))
    s = st.agreement_by(counts, ["k", "axis"])
    wide = s.groupBy("k").agg(*[F.max(F.when(F.col("axis") == x, F.col(m))).alias(f"{m}_{x}") for x in ("label", "parity") for m in ("nmi", "homogeneity")])
    best, finest = F.max_by("k", F.struct("nmi_label", -F.col("k"))), F.max_by(F.col("nmi_label") > F.col("nmi_parity") + 0.05, "k")
    verdict = wide.agg(best.alias("best_k"), F.when(finest, "fine").otherwise("coarse").alias("verdict"))
    return wide.join(cost, "k").crossJoin(F.broadcast(verdict)).select("k", F.round("inertia", 4).alias("inertia"), "nmi_label", "homogeneity_label", "nmi_parity", "homogeneity_parity", "best_k", "verdict")


@query()
def seed_stability(t: Tables) -> DataFrame:
    """Agreement of partitions from different seeds, pair by pair."""
    parts = [clusters(t, 8, s).select("id", F.col("cluster").alias(f"c{s}")) for s in range(3)]
    j = parts[0].join(parts[1], "id").join(parts[2], "id").cache()
    out = None
    for a, b in ((0, 1), (0, 2), (1, 2)):
        one = st.agreement(j.groupBy(F.col(f"c{a}").alias("a"), F.col(f"c{b}").alias("b")).agg(F.count("*").alias("n"))).select(F.lit(a).alias("seed_a"), F.lit(b).alias("seed_b"), "ari", "nmi")
        out = one if out is None else out.union(one)
    return out


@query()
def community_retrieval(t: Tables) -> DataFrame:
    """Communities by k-means, their centroids as summaries, the five most central rows each; three communities answer a query."""
    c = clusters(t, 12)
    centre = mean_pool(c, ["cluster"], "v")
    near = c.join(centre.withColumnRenamed("v", "c"), "cluster").withColumn("sim", F.round(dot(F.col("v"), F.col("c")), 6))
    w = Window.partitionBy("cluster").orderBy(F.desc("sim"), "id")
    members = near.withColumn("place", F.row_number().over(w)).where("place <= 5").select("cluster", "id", "place")
    top = dense.topk(as_queries(vectors(t)), centre.withColumnRenamed("cluster", "id"), 3)
    return top.select("qid", F.col("id").alias("cluster"), F.col("rank").alias("community")).join(members, "cluster").select("qid", "community", "id", "place")


def folds(t: Tables) -> DataFrame:
    """Five folds, each label dealt evenly in hash order."""
    w = Window.partitionBy("label").orderBy(draw_key("id", "fold"), "id")
    return with_vector(t).withColumn("fold", F.row_number().over(w) % 5)


def scores_by_fold(df: DataFrame, make) -> DataFrame:
    """(fold, n, accuracy, top2) of models fitted on the other folds."""
    out = None
    for k in range(5):
        p = make(df.where(F.col("fold") != k)).transform(df.where(F.col("fold") == k))
        prob = vector_to_array("probability")
        place = F.size(F.filter(prob, lambda x: x > F.element_at(prob, F.col("label").cast("int") + 1)))
        one = p.agg(F.lit(k).alias("fold"), F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 6).alias("accuracy"), F.round(F.avg((place < 2).cast("int")), 6).alias("top2"))
        out = one if out is None else out.union(one)
    return out


@query()
def logreg_router_cv(t: Tables) -> DataFrame:
    return scores_by_fold(folds(t).cache(), LogisticRegression(featuresCol="x", labelCol="label", maxIter=15, regParam=0.1).fit)


@query()
def tfidf_router_cv(t: Tables) -> DataFrame:
    """Word 1- and 2-grams, sublinear tf-idf, class weights; the language is the class."""
    codes = F.create_map(*[F.lit(x) for i, k in enumerate(("de", "en", "es", "fr")) for x in (k, float(i))])
    d = t.documents.where("text IS NOT NULL").select("doc_id", "text", F.try_element_at(codes, F.col("lang")).alias("label")).where("label IS NOT NULL")
    w = Window.partitionBy("label").orderBy(draw_key("doc_id", "fold"), "doc_id")
    d = d.withColumn("fold", F.row_number().over(w) % 5)
    tok = RegexTokenizer(inputCol="text", outputCol="w", pattern="\\W+").transform(d)
    both = NGram(n=2, inputCol="w", outputCol="w2").transform(tok)
    n = both.groupBy("label").agg(F.count("*").alias("m"))
    grams = both.join(n, "label").select("label", "fold", F.concat("w", "w2").alias("g"), (1.0 / F.col("m")).alias("weight"))
    # The window deals rows by language, so to a few tasks; every pass of a fit should keep all cores busy.
    return scores_by_fold(grams.repartition(t.spark.sparkContext.defaultParallelism).cache(), fit_tfidf)


def fit_tfidf(train: DataFrame):
    """Vocabulary, idf and classifier of the training folds alone; counts go in as 1 + ln(tf)."""
    counts = CountVectorizer(inputCol="g", outputCol="c", vocabSize=VOCABULARY, minDF=2)
    sublinear = SQLTransformer(statement="SELECT *, sublinear(c) AS tf FROM __THIS__")
    damp = lambda v: Vectors.sparse(v.size, v.indices, 1 + np.log(v.values))
    train.sparkSession.udf.register("sublinear", damp, VectorUDT())
    probe = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=10, regParam=0.01)
    return Pipeline(stages=[counts, sublinear, IDF(inputCol="tf", outputCol="x"), probe]).fit(train)


# --- theory of dilution


def _draw_sql(seed: str, *keys: str) -> str:
    return f"('0x' || substr(md5('{seed}' || ':' || {" || ':' || ".join(keys)}), 1, 8))::BIGINT / 4294967296.0"


@query(
    f"""WITH {KNN}, x AS (SELECT qid, id, rank, (ql = l)::INT AS same, k.keep, g.draw FROM r, (VALUES (0.25), (0.5), (1.0)) AS k(keep), generate_series(0, 19) AS g(draw) WHERE rank <= 80 AND {_draw_sql('thin', 'id', 'g.draw')} < k.keep),
t AS (SELECT *, row_number() OVER (PARTITION BY keep, draw, qid ORDER BY rank) AS n FROM x) SELECT keep::DOUBLE AS keep, round(avg(same), 6) AS purity FROM t WHERE n <= 10 GROUP BY keep"""
)
def thinning_prediction(t: Tables) -> DataFrame:
    """Expected purity of the ten nearest when each corpus row is kept with a chance: 20 hash-seeded thinnings of stored lists of 80."""
    nb = neighbours(t, 80).select("qid", "id", "rank", (F.col("ql") == F.col("l")).alias("same"))
    x = nb.withColumn("keep", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19))))
    w = Window.partitionBy("keep", "draw", "qid").orderBy("rank")
    top = x.where(draw("thin", "id", "draw") < F.col("keep")).withColumn("r", F.row_number().over(w)).where("r <= 10")
    return top.groupBy("keep").agg(F.round(F.avg(F.col("same").cast("int")), 6).alias("purity"))


@query(
    f"""WITH {KNN}, n AS (SELECT count(*) AS n FROM e), u AS (SELECT vec_id AS id, {_draw_sql('sizes', 'vec_id')} AS u FROM e),
m AS (SELECT k.step, s.qid, max(s.sim) AS m FROM s JOIN u USING (id), generate_series(0, 5) AS k(step) WHERE u.u < power(2, -k.step) GROUP BY ALL),
p AS (SELECT step, avg(m) AS best, any_value(n.n) * power(2, -step) AS n FROM m, n GROUP BY step)
SELECT p.n, round(p.best, 6) AS best, round(regr_intercept(p.best, sqrt(2 * ln(p.n))) OVER (), 4) AS a, round(regr_slope(p.best, sqrt(2 * ln(p.n))) OVER (), 4) AS b, round(regr_r2(p.best, sqrt(2 * ln(p.n))) OVER (), 4) AS r2 FROM p"""
)
def extreme_value_curve(t: Tables) -> DataFrame:
    """Mean best similarity in hash samples of growing size, and the fit a + b sqrt(2 ln n); the sizes are a report's few points."""
    v = vectors(t)
    n, q, best = v.count(), as_queries(v), None
    for step in range(6):
        part = v.where(draw("sizes", "id") < 2.0**-step)
        one = dense.topk(q, part, 1, exclude_self=True).agg(F.lit(n * 2.0**-step).alias("n"), F.avg("sim").alias("best"))
        best = one if best is None else best.union(one)
    pts = [r for r in best.collect() if r.best is not None]
    a, b, r2 = st.extreme_value_fit(np.array([r.n for r in pts]), np.array([r.best for r in pts])) if len(pts) > 1 else (0.0, 0.0, 0.0)
    return t.spark.createDataFrame([(float(r.n), round(r.best, 6), round(a, 4), round(b, 4), round(r2, 4)) for r in pts], "n double, best double, a double, b double, r2 double")


@query(f"WITH {KNN}, c AS (SELECT qid, min(sim) FILTER (rank <= 10) AS cut FROM r GROUP BY qid) SELECT CASE WHEN ql = l THEN 'same' WHEN l % 2 = ql % 2 THEN 'sibling' ELSE 'other' END AS population, count(*) AS n FROM r JOIN c USING (qid) WHERE sim >= cut GROUP BY ALL")
def tail_composition(t: Tables) -> DataFrame:
    """Who lies at or above each query's tenth similarity: its label, a sibling label, others. Rows tied with the tenth count."""
    v = vectors(t)
    found = dense.topk(as_queries(v), v, 10, exclude_self=True, ties=True)
    nb = found.join(v.select("id", F.col("label").alias("l")), "id").join(v.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid")
    kind = F.when(F.col("ql") == F.col("l"), "same").when(F.col("l") % 2 == F.col("ql") % 2, "sibling").otherwise("other")
    return nb.groupBy(kind.alias("population")).agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT vec_id, len(v)::BIGINT AS dim, round(sqrt(list_dot_product(v, v)), 6) AS length, round(v[1], 6) AS first, round(v[len(v)], 6) AS last FROM e")
def vector_scan(t: Tables) -> DataFrame:
    """Every vector read by its place in the stored array: size, length and both ends."""
    v = t.embeddings.select("vec_id", doubles("embedding").alias("v"))
    at = lambda i: F.round(F.element_at("v", i), 6)
    return v.select("vec_id", F.size("v").cast("bigint").alias("dim"), F.round(F.sqrt(dot(F.col("v"), F.col("v"))), 6).alias("length"), at(1).alias("first"), at(-1).alias("last"))


TAUS = (0.0, 0.02, 0.05, 0.1)


@query(
    f"""WITH {KNN}, {CENTROIDS}, one AS (SELECT a.qid, a.scope, round(a.sim - b.sim, 6) AS conf FROM rt a JOIN rt b USING (qid) WHERE a.rank = 1 AND b.rank = 2),
c AS (SELECT qid, conf, (scope = ql)::INT AS routed, (l = ql)::INT AS everywhere FROM one JOIN r USING (qid) WHERE r.rank = 1), tau AS (SELECT unnest({list(TAUS)})::DOUBLE AS tau)
SELECT tau, round(avg((conf < tau)::INT), 6) AS fallback_rate, round(avg(CASE WHEN conf < tau THEN everywhere ELSE routed END), 6) AS correctness FROM c, tau GROUP BY tau"""
)
def tau_fallback_sweep(t: Tables) -> DataFrame:
    """The router's lead of its first scope over the second is its confidence; below each threshold the nearest row of
    the whole corpus answers in its place. Right is the query's own label."""
    r = settle(route(t, 2))
    one = r.where("rank = 1").select("qid", "scope", F.col("sim").alias("a")).join(r.where("rank = 2").select("qid", F.col("sim").alias("b")), "qid")
    near = neighbours(t, 1).select("qid", (F.col("l") == F.col("ql")).cast("int").alias("everywhere"), "ql")
    c = one.join(near, "qid").select("qid", F.round(F.col("a") - F.col("b"), 6).alias("conf"), (F.col("scope") == F.col("ql")).cast("int").alias("routed"), "everywhere")
    x = choose_by_threshold(c, "conf", list(TAUS), "routed", "everywhere")
    return x.groupBy("tau").agg(F.round(F.avg(F.col("fallback").cast("int")), 6).alias("fallback_rate"), F.round(F.avg("chosen"), 6).alias("correctness"))


@query(f"WITH {KNN}, c AS (SELECT qid, count(*) AS n FROM r WHERE rank <= 100 GROUP BY qid) SELECT n AS found, count(*) AS queries FROM c GROUP BY n")
def batched_top100(t: Tables) -> DataFrame:
    n = neighbours(t, 100).groupBy("qid").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("n").alias("found")).agg(F.count("*").alias("queries"))


@query(f"WITH {SCOPED}, rt AS (SELECT vec_id AS qid, label AS scope FROM e) SELECT p.qid, p.id, p.srank AS rank FROM p JOIN rt ON rt.qid = p.qid AND rt.scope = p.l WHERE srank <= 3")
def router_then_scope(t: Tables) -> DataFrame:
    """A lookup join gives each query its scope, which is then searched."""
    scopes = vectors(t).select(F.col("id").alias("qid"), F.col("label").cast("string").alias("scope"))
    q = as_queries(vectors(t)).select("qid", "v").join(scopes, "qid")
    corpus = vectors(t).withColumn("scope", F.col("label").cast("string"))
    return dense.topk(q, corpus, 3, exclude_self=True).select("qid", "id", F.col("rank").cast("bigint"))



def _mean_sql(total: str, n: str) -> str:
    """The mean of ``n`` whole numbers of that total, rounded half up; shifted so that none is negative."""
    return f"((2 * ({total} + {n} * 1000000) + {n}) // (2 * {n}) - 1000000)"


ROUNDS = f"""{SCOPED}, {CENTROIDS}, a AS (SELECT m.round, p.qid, count(*) AS context, sum(CAST(round(p.sim * 1000000) AS BIGINT))::BIGINT AS total FROM (VALUES (0, 1), (1, 2), (2, 4)) AS m(round, m), p JOIN rt ON rt.qid = p.qid AND rt.scope = p.l WHERE rt.rank <= m.m AND p.srank <= 5 GROUP BY ALL),
b AS (SELECT *, {_mean_sql("total", "context")} AS q FROM a),
o AS (SELECT *, coalesce(max(q) OVER (PARTITION BY qid ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)"""


@query(f"WITH {ROUNDS} SELECT qid, round, context, q / 1000000 AS quality FROM o WHERE before < 350000")
def refinement_loop(t: Tables) -> DataFrame:
    """Three rounds that deepen each query's scopes while its mean similarity is low; all queries of a round are one batch."""
    v = vectors(t)
    corpus = v.withColumn("scope", F.col("label").cast("string"))
    q, out = as_queries(v).select("qid", "v"), None
    for round_, m in enumerate((1, 2, 4)):
        # The m nearest scopes of the queries that are still open.
        scopes = route(t, m).select("qid", F.col("scope").cast("string").alias("scope"))
        found = dense.topk(q.join(scopes, "qid").withColumn("list", F.col("scope")), corpus, 5, exclude_self=True)
        found = settle(found)
        # Whole millionths, so that neither the mean nor the test depends on the order of additions.
        sums = found.groupBy("qid").agg(F.count("*").alias("context"), F.sum(F.round(F.col("sim") * 1_000_000).cast("bigint")).alias("total"))
        quality = sums.withColumn("q", F.expr("(2 * (total + context * 1000000) + context) div (2 * context) - 1000000"))
        one = quality.select("qid", F.lit(round_).alias("round"), "context", (F.col("q") / 1_000_000).alias("quality"))
        out = one if out is None else out.union(one)
        # The next round reads only the queries that are still open, not this round's work again.
        q = settle(q.join(quality.where("q < 350000").select("qid"), "qid", "left_semi"))
    return out
