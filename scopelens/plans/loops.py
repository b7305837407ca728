"""Queries on loops over all queries at once: refinement by tiers, and reasoning with tools."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import dense, lexical, loops
from ..session import settle
from .registry import Tables, query
from .retrieval import BM25, CENTROIDS, SCOPED, route, vectors

#: Similarities to a scope's centroid from which on it is read first, to full depth or not; potential scopes' last place.
HIGH, MODERATE, POTENTIAL = 0.1, 0.05, 5
ROUNDS, SECONDS, CALL_SECONDS = 4, 90, 4
#: The stand-in judge: rows of that similarity, in millionths, cover; the best rows' mean, so many times over, is validity.
COVERS, PER_ROW, BEST, VALID_TIMES = 150_000, 30_000, 5, 2


def _found_sql(name: str, asks: str) -> str:
    """(qid, id, sim) of asks (qid, part, scope, depth, v), sim in millionths."""
    return f"""{name}_s AS MATERIALIZED (SELECT a.qid, a.part, a.scope, a.depth, x.vec_id AS id, round(list_dot_product(a.v, x.v), 6) AS sim FROM {asks} a JOIN e x ON x.vec_id <> a.qid AND (a.scope IS NULL OR a.scope = x.label)),
{name} AS (SELECT qid, id, max(CAST(round(sim * 1000000) AS BIGINT)) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid, part, scope ORDER BY sim DESC, id) AS r FROM {name}_s) WHERE r <= depth GROUP BY qid, id)"""


def _round_sql(i: int) -> str:
    """Evidence ev{i} and state st{i} to ev{i + 1} and st{i + 1}."""
    return f"""tp{i} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS r FROM ev{i}),
mk{i} AS (SELECT qid, least(1000000, {PER_ROW} * count(*) FILTER (sim >= {COVERS}))::BIGINT AS c, least(1000000, greatest(0, {VALID_TIMES} * coalesce(sum(sim) FILTER (r <= {BEST}), 0) // {BEST}))::BIGINT AS val FROM tp{i} GROUP BY qid),
jd{i} AS (SELECT s.*, {SECONDS} - {CALL_SECONDS} * calls AS lft, coalesce(c, 0) AS c, coalesce(val, 0) AS val, (coalesce(c, 0) + coalesce(val, 0)) // 2 AS q FROM st{i} s LEFT JOIN mk{i} USING (qid)),
hw{i} AS (SELECT *, CASE WHEN c < 750000 AND val < 700000 AND lft > 20 THEN 'Hybrid' WHEN c < 750000 AND lft > 15 THEN 'Depth' WHEN val < 700000 AND lft > 10 THEN 'Breadth' ELSE 'Stop' END AS how,
  reason IS NULL AND lft >= {loops.LEAST_SECONDS} AS judged, previous IS NOT NULL AND abs(q - previous) < {loops.LEAST_GAIN} AS flat FROM jd{i}),
nw{i} AS (SELECT qid, calls, lft, how, CASE WHEN judged THEN {i + 1} ELSE rounds END AS rounds, CASE WHEN judged THEN q ELSE previous END AS previous, CASE WHEN judged AND q > best THEN q ELSE best END AS best,
  CASE WHEN judged AND q > best THEN {i} ELSE best_round END AS best_round, CASE WHEN judged AND q < {loops.GOOD} AND NOT flat THEN list_append(strategies, how) ELSE strategies END AS strategies,
  CASE WHEN reason IS NOT NULL THEN reason WHEN lft < {loops.LEAST_SECONDS} THEN 'time_budget' WHEN q >= {loops.GOOD} THEN 'quality_threshold' WHEN flat THEN 'stagnation' WHEN how = 'Stop' THEN 'stop_strategy' END AS reason FROM hw{i}),
sc{i} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS no FROM (SELECT t.*, n.how, n.lft, row_number() OVER (PARTITION BY t.qid, tier ORDER BY place) AS k FROM tier t JOIN nw{i} n ON n.qid = t.qid WHERE n.reason IS NULL)
  WHERE (how IN ('Depth', 'Hybrid') AND tier IN ('HIGH', 'MODERATE')) OR (how IN ('Breadth', 'Hybrid') AND tier = 'POTENTIAL' AND k <= {loops.MOST_EXPANDED})),
fu{i} AS (SELECT t.qid, t.r AS part, list_transform(list_zip(a.v, b.v), lambda p: (p[1] + p[2]) / 2) AS v FROM tp{i} t JOIN e a ON a.vec_id = t.qid JOIN e b ON b.vec_id = t.id WHERE t.r <= {loops.MOST_FOLLOW_UPS}),
cl{i} AS (SELECT qid, part, scope, CASE WHEN tier = 'HIGH' THEN 20 ELSE 5 END AS depth, v FROM (SELECT s.*, f.part, f.v, row_number() OVER (PARTITION BY s.qid ORDER BY part, no) - 1 AS call FROM sc{i} s JOIN fu{i} f ON f.qid = s.qid WHERE no <= {loops.MOST_SCOPES}) WHERE lft - {CALL_SECONDS} * call >= {loops.LEAST_SECONDS}),
{_found_sql(f"fd{i}", f"cl{i}")},
ev{i + 1} AS MATERIALIZED (SELECT qid, id, max(sim) AS sim FROM (SELECT * FROM ev{i} UNION ALL SELECT * FROM fd{i}) GROUP BY qid, id),
st{i + 1} AS MATERIALIZED (SELECT n.qid, calls + coalesce(made, 0) AS calls, rounds, previous, best, best_round, strategies, reason FROM nw{i} n LEFT JOIN (SELECT qid, count(*) AS made FROM cl{i} GROUP BY qid) USING (qid))"""


REFINED = f"""{SCOPED}, {CENTROIDS}, tier AS (SELECT qid, scope, rank AS place, CASE WHEN rank = 1 AND sim >= {HIGH} THEN 'HIGH' WHEN rank <= 2 AND sim >= {MODERATE} THEN 'MODERATE' WHEN rank <= {POTENTIAL} THEN 'POTENTIAL' ELSE 'IRRELEVANT' END AS tier FROM rt),
fs AS (SELECT qid, count(*) AS n FROM tier WHERE tier IN ('HIGH', 'MODERATE') GROUP BY qid),
st0 AS (SELECT vec_id AS qid, coalesce(n, 1) AS calls, 0 AS rounds, CAST(NULL AS BIGINT) AS previous, -1::BIGINT AS best, CAST(NULL AS BIGINT) AS best_round, CAST([] AS VARCHAR[]) AS strategies, CASE WHEN n IS NULL THEN 'global_fallback' END AS reason FROM e LEFT JOIN fs ON fs.qid = vec_id),
ca AS (SELECT t.qid, 0 AS part, t.scope, CASE WHEN tier = 'HIGH' THEN 20 ELSE 5 END AS depth, e.v FROM tier t JOIN e ON e.vec_id = t.qid WHERE tier IN ('HIGH', 'MODERATE') UNION ALL SELECT qid, 0, NULL, 20, e.v FROM st0 JOIN e ON e.vec_id = qid WHERE reason IS NOT NULL),
{_found_sql("ev0", "ca")}, {", ".join(_round_sql(i) for i in range(ROUNDS))}"""


def judged(held: DataFrame) -> DataFrame:
    """The stand-in judge, in whole millionths."""
    top = held.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "id")))
    covered = F.count(F.when(F.col("sim") >= COVERS, 1)) * PER_ROW
    best = F.coalesce(F.sum(F.when(F.col("r") <= BEST, F.col("sim"))), F.lit(0))
    one = F.lit(loops.MICRO).cast("bigint")
    return top.groupBy("qid").agg(F.least(one, covered).alias("coverage"), best.alias("b")).select("qid", "coverage", F.least(one, F.greatest(F.lit(0).cast("bigint"), F.expr(f"({VALID_TIMES} * b) div {BEST}"))).alias("validity"))


@query(f"WITH {REFINED} SELECT qid, rounds::BIGINT AS rounds, coalesce(reason, 'rounds') AS reason, array_to_string(strategies, ',') AS strategies, CASE WHEN best >= 0 THEN best / 1000000 END AS quality, best_round, calls, (SELECT count(*) FROM ev{ROUNDS} x WHERE x.qid = s.qid) AS evidence FROM st{ROUNDS} s")
def tiered_refinement(t: Tables) -> DataFrame:
    """Scopes by tier, evidence, a judge, and rounds that go deeper or wider until one of six reasons ends them; the
    judge and the follow-up questions (the query moved towards its two best rows) are stand-ins."""
    states, evidence = refined(t, ROUNDS)
    n = evidence.groupBy("qid").agg(F.count("*").alias("evidence"))
    return states.join(n, "qid", "left").select("qid", "rounds", "reason", "strategies", "quality", "best_round", "calls", F.coalesce("evidence", F.lit(0)).alias("evidence"))


@query(f"WITH {REFINED} SELECT qid, CASE WHEN reason IS NULL THEN how END AS strategy FROM hw0 WHERE reason IS NOT NULL OR q < {loops.GOOD}")
def strategy_selector(t: Tables) -> DataFrame:
    """How each query's loop goes on after its first judgement, by coverage, validity and time left; null where it was
    answered from the whole corpus. Queries that are good enough at once have no strategy and no row."""
    states, _ = refined(t, 1)
    return states.where("reason <> 'quality_threshold'").select("qid", F.nullif("strategies", F.lit("")).alias("strategy"))


def refined(t: Tables, rounds: int) -> tuple[DataFrame, DataFrame]:
    v = settle(vectors(t))
    corpus = v.withColumn("scope", F.col("label").cast("string"))
    queries = v.select(F.col("id").alias("qid"), F.col("v").alias("ask"))
    sim, place = F.col("sim"), F.col("rank")
    tier = F.when((place == 1) & (sim >= HIGH), "HIGH").when((place <= 2) & (sim >= MODERATE), "MODERATE").when(place <= POTENTIAL, "POTENTIAL").otherwise("IRRELEVANT")
    tiers = settle(route(t, 1 << 20).select("qid", F.col("scope").cast("string").alias("scope"), tier.alias("tier"), place.alias("place")))

    def search(asks: DataFrame) -> DataFrame:
        q = asks.select("qid", F.col("ask").alias("v"), "scope", F.concat_ws("/", "depth", "part", "scope").alias("list"))
        found = dense.topk(q, corpus, max(loops.DEPTHS.values()), exclude_self=True)
        return found.where(F.col("rank") <= F.split_part("list", F.lit("/"), F.lit(1)).cast("int")).select("qid", "id", F.round(F.col("sim") * loops.MICRO).cast("bigint").alias("sim"))

    def follow(held: DataFrame, asked: DataFrame) -> DataFrame:
        top = held.withColumn("part", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "id"))).where(F.col("part") <= loops.MOST_FOLLOW_UPS)
        return top.join(v.select("id", "v"), "id").join(asked, "qid").select("qid", "part", F.zip_with("ask", "v", lambda a, b: (a + b) / 2).alias("ask"))

    return loops.refine(queries, tiers, search, judged, follow, rounds, SECONDS, CALL_SECONDS)


#: Tools of the reasoning loop: a language each, and one for everything.
TOOLS = {"search_en": "en", "search_de": "de", "search_es": "es", "search_fr": "fr", "search_all": ""}


class Scripted:
    """A stand-in that reasons by the number of observations and the question's length n: n % 9 calls, then an answer.

    The call of round i asks tool (n + i) % 6 with the whole question; the sixth tool doesn't exist. Where 11
    divides n, its first reply is idle talk. Its answer is the first id it has seen.
    """

    def generate(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        question = prompt.removeprefix("Question: ").split("\n\nBegin.", 1)[0]
        n, seen = len(question), re.findall(r"^\[(-?\d+)\]", prompt, re.M)
        step = prompt.count("\n\nObservation:\n") + prompt.count("You must emit either")
        if prompt.endswith("Emit Final Answer: now."):
            return f"That is all. Final Answer: {seen[0] if seen else 'none'} (forced)"
        if n % 11 == 0 and step == 0:
            return "Let me think about it."
        if step >= n % 9:
            return f"I have enough.\nFinal Answer: {seen[0] if seen else 'none'}"
        tool = [*TOOLS, "search_nothing"][(n + step) % (len(TOOLS) + 1)]
        return f'Thought: look it up.\nAction: {tool}({{"query": "q{step}"}})'


NAMES = "[" + ", ".join(f"'{n}'" for n in [*TOOLS, "search_nothing"]) + "]"
SCOPES = "[" + ", ".join(f"'{s}'" for s in TOOLS.values()) + "]"


@query(
    f"""WITH {BM25}, n AS (SELECT item_id, length(text) AS n, length(text) % 9 AS m, CASE WHEN length(text) % 11 = 0 THEN 1 ELSE 0 END AS idle FROM benchmark),
k AS (SELECT item_id, n, i, (n + i) % 6 AS tool FROM n, generate_series(0, 5) AS g(i) WHERE i < m AND i >= idle),
s AS (SELECT k.item_id, k.i, b.doc_id, row_number() OVER (PARTITION BY k.item_id, k.i ORDER BY b.score DESC, b.doc_id) AS rank FROM k JOIN b USING (item_id) JOIN documents d USING (doc_id) WHERE tool < 5 AND ({SCOPES}[tool + 1] = '' OR d.lang = {SCOPES}[tool + 1])),
f AS (SELECT item_id, doc_id, min(i * 10 + rank) AS pl FROM s WHERE rank <= 3 GROUP BY item_id, doc_id),
w AS (SELECT item_id, list(doc_id ORDER BY pl, doc_id) AS ids FROM f GROUP BY item_id),
r AS (SELECT item_id, greatest(m, idle) AS steps, m FROM n)
SELECT item_id, least(steps + 1, 6)::BIGINT AS iterations, least(steps + 1, 7)::BIGINT AS model_calls, CASE WHEN steps < 6 THEN 'final_answer' ELSE 'max_iters' END AS reason, coalesce(ids[1]::VARCHAR, 'none') || CASE WHEN steps < 6 THEN '' ELSE ' (forced)' END AS answer,
coalesce((SELECT string_agg({NAMES}[tool + 1], ',' ORDER BY i) FROM k WHERE k.item_id = r.item_id), '') AS tools, coalesce(array_to_string(ids, ','), '') AS ids FROM r LEFT JOIN w USING (item_id)"""
)
def reasoning_loop(t: Tables) -> DataFrame:
    """Up to six rounds of thought, tool call and observation; tools search by language, open questions are forced to answer."""
    index = t.text_index()
    texts = t.documents.select("doc_id", F.substring("text", 1, 40).alias("text"))
    questions = settle(t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question")))

    def search(asks: DataFrame) -> DataFrame:
        """The stand-in's queries are labels; the words sought are the question's own."""
        q = asks.join(questions, "qid").select(F.col("qid").alias("item_id"), F.col("question").alias("text"), F.col("scope").alias("lang"))
        top = settle(index.topk(q, 3, scope="lang", every=True))
        return lexical.light(top)(top).join(texts, "doc_id").select(F.col("item_id").alias("qid"), F.col("doc_id").alias("id"), "rank", F.regexp_replace("text", r"\s+", " ").alias("text"))

    done = loops.react(questions, search, TOOLS, Scripted)
    return done.select(F.col("qid").alias("item_id"), "iterations", "model_calls", "reason", "answer", F.array_join("tools", ",").alias("tools"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
