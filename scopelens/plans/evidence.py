"""Queries on answers from stored evidence, stepwise answering, blind annotation, projections and power."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import chunking, dense, systems
from ..operators.sampling import draw_key
from .registry import Tables, query
from .retrieval import SCOPED, vectors
from .systems import with_vector


@query()
def rechunk_per_source(t: Tables) -> DataFrame:
    """A conversation's turns, joined in order and split again; the conversation stands for a source."""
    c = t.conversations.withColumn("turn", F.col("turn").cast("bigint"))
    return chunking.rechunk(c, "conv_id", "turn", "text").select("conv_id", "part", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


@query(
    """WITH r AS (SELECT item_id, text, [item_id * 3, item_id, -1, item_id + 1] AS ids FROM benchmark WHERE item_id % 5 <> 0),
x AS (SELECT item_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM r),
j AS (SELECT x.*, d.source, d.lang, d.n_chars, d.text, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS i FROM x JOIN documents d ON d.doc_id = x.id),
c AS (SELECT item_id, count(*) AS n_chunks, string_agg('[SOURCE ' || i || ': ' || source || ', ' || lang || ', Year ' || coalesce(n_chars::VARCHAR, 'n/a') || ']' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY pos) AS context FROM j GROUP BY item_id)
SELECT item_id, coalesce(n_chunks, 0) AS n_chunks, md5(coalesce(context, '')) AS context_md5, list_last(string_split(trim(text), chr(10))) AS answer FROM r LEFT JOIN c USING (item_id)"""
)
def forced_format_evidence(t: Tables) -> DataFrame:
    """Stored runs answered again from the texts they had found, those of every fifth item being done already."""
    i = F.col("item_id")
    runs = t.benchmark.select("item_id", F.col("text").alias("query"), F.array(i * 3, i, F.lit(-1).cast("bigint"), i + 1).alias("ids"))
    done = t.benchmark.where("item_id % 5 = 0")
    texts = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("section"), F.col("n_chars").alias("year"), "text")
    return systems.resynthesise(runs, done, texts, "item_id").select("item_id", "n_chunks", F.md5("context").alias("context_md5"), "answer")


STEPS = f"""{SCOPED}, st AS (SELECT vec_id AS qid, i AS step, (label + 3 * i) % 10 AS task FROM e, generate_series(0, 2) AS g(i)),
f AS (SELECT st.qid, st.step, p.id, p.srank, p.sim FROM st JOIN p ON p.qid = st.qid AND p.l = st.task AND p.srank <= 5),
o AS (SELECT qid, step, count(*) AS n, count(*) FILTER (sim >= 0.2) AS notes, min_by(id, srank) FILTER (sim >= 0.2) AS first FROM f GROUP BY qid, step),
w AS (SELECT st.qid, st.step, coalesce(n, 0) AS n, coalesce(notes, 0) AS notes, first, coalesce(min(CASE WHEN coalesce(notes, 0) >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY st.qid ORDER BY st.step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS runs FROM st LEFT JOIN o ON o.qid = st.qid AND o.step = st.step)"""


@query(f"WITH {STEPS} SELECT qid, count(*) AS steps, CASE WHEN count(*) < 3 THEN 'step_failed' ELSE 'summary' END AS reason, sum(n)::BIGINT AS n_chunks, coalesce(max_by(first, step) FILTER (first IS NOT NULL)::VARCHAR, '') AS answer FROM w WHERE runs = 1 GROUP BY qid")
def planned_steps_system(t: Tables) -> DataFrame:
    """A plan of three scopes per query, one step each: five passages, notes on those that are similar, an answer; a step
    with fewer than three notes ends the plan. The models are stand-ins."""
    v = vectors(t)
    corpus = v.withColumn("scope", F.col("label").cast("string"))
    scope = lambda i: ((F.col("label") + 3 * i) % 10).cast("string")
    plans = v.select(F.col("id").alias("qid"), F.lit("find").alias("question"), F.array(*[scope(i) for i in range(3)]).alias("tasks"))
    queries = v.select(F.col("id").alias("qid"), "v")

    def search(now: DataFrame) -> DataFrame:
        found = dense.topk(now.join(queries, "qid").select("qid", "v", F.col("task").alias("scope")), corpus, 5, exclude_self=True)
        return found.select("qid", "id", "rank", F.when(F.col("sim") >= 0.2, F.col("id").cast("string")).otherwise("").alias("text"))

    return systems.planned_steps(plans, search, depth=5)


@query(
    """WITH a AS (SELECT user_id AS query, event_type AS system, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
b AS (SELECT query, system, n, count(*) OVER (PARTITION BY query) AS sides, row_number() OVER (PARTITION BY query ORDER BY md5('blind:' || query || ':' || system), system) AS i FROM a)
SELECT query || '_' || CASE i WHEN 1 THEN 'A' ELSE 'B' END AS uid, query, system, n AS answer FROM b WHERE sides = 2"""
)
def blind_sheet(t: Tables) -> DataFrame:
    """Both systems' answers to a query under letters that a hash deals out; the sheet leaves out ``system``, the key keeps it."""
    runs = t.events.where("event_type IN ('click', 'view')").groupBy(F.col("user_id").alias("query"), F.col("event_type").alias("system")).agg(F.count("*").alias("answer"))
    w = Window.partitionBy("query")
    dealt = runs.withColumn("_pair", F.concat_ws(":", "query", "system"))
    i = F.row_number().over(w.orderBy(draw_key("_pair", "blind"), "system"))
    both = dealt.withColumns({"_n": F.count("*").over(w), "_i": i}).where("_n = 2")
    return both.select(F.concat("query", F.lit("_"), F.when(F.col("_i") == 1, "A").otherwise("B")).alias("uid"), "query", "system", "answer")


@query()
def pca_projection(t: Tables) -> DataFrame:
    """Each vector on its two first principal axes; an axis points to where its largest loading is positive."""
    v = with_vector(t)
    model = PCA(k=2, inputCol="x", outputCol="y").fit(v)
    axes = model.pc.toArray()
    sign = [1.0 if a[abs(a).argmax()] > 0 else -1.0 for a in axes.T]
    y = vector_to_array("y")
    return model.transform(v).select("id", *[F.round(y[i] * sign[i], 6).alias(n) for i, n in enumerate(("pc1", "pc2"))])
