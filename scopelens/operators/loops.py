"""Loops over all queries at once: a state row for each query, advanced by batch steps until no query is open.

Every step reads the open queries only, and its state and evidence are written to the shared folder, so a plan never
grows with the rounds and a lost executor costs tasks of one step. Searches, judges and models are parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import strategy
from ..session import settle
from .systems import Extractive, LanguageModel, generate

#: Shares are whole millionths, so sums and tests don't depend on the order of additions.
MICRO = 1_000_000
#: A loop ends at this quality, below this gain, or with less than so many seconds left.
GOOD, LEAST_GAIN, LEAST_SECONDS = 850_000, 50_000, 5
#: Rows read of a scope by its tier, and scopes and follow-up questions of a round.
DEPTHS, MOST_SCOPES, MOST_EXPANDED, MOST_FOLLOW_UPS = {"HIGH": 20, "MODERATE": 5, "POTENTIAL": 5}, 4, 2, 2


def _best_of(found: DataFrame, more: DataFrame) -> DataFrame:
    return found.unionByName(more).groupBy("qid", "id").agg(F.max("sim").alias("sim"))


def refine(
    queries: DataFrame,
    tiers: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    judge: Callable[[DataFrame], DataFrame],
    follow: Callable[[DataFrame, DataFrame], DataFrame],
    rounds: int = 2,
    seconds: int = 90,
    call_seconds: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Tiers, partial results, synthesis, judgement and refinement; returns the states and the evidence.

    queries: (qid, ask); tiers: (qid, scope, tier, place), by falling relevance. ``search`` maps
    (qid, part, scope, depth, ask) to (qid, id, sim), sim in millionths; a null scope is the whole corpus.
    ``judge`` maps evidence (qid, id, sim) to (qid, coverage, validity) in millionths, ``follow`` evidence and
    queries to follow-up questions (qid, part, ask). High and moderate scopes are read first; a query without any
    is answered from the whole corpus and not refined. Each round judges the evidence, then goes deeper into the
    same scopes, wider into potential ones, or both. Every call takes ``call_seconds`` of ``seconds``.

    States: (qid, rounds, reason, strategies, quality, best_round, calls); reason is one of global_fallback,
    time_budget, quality_threshold, stagnation, stop_strategy and rounds.
    """
    near = tiers.where(F.col("tier").isin("HIGH", "MODERATE"))
    depth = F.create_map(*[x for t, d in DEPTHS.items() for x in (F.lit(t), F.lit(d))])
    first = near.groupBy("qid").agg(F.count("*").alias("n"))
    state = queries.select("qid").join(first, "qid", "left").select(
        "qid",
        F.coalesce("n", F.lit(1)).cast("bigint").alias("calls"),
        F.lit(0).cast("bigint").alias("rounds"),
        F.lit(None).cast("bigint").alias("previous"),
        F.lit(-1).cast("bigint").alias("best"),
        F.lit(None).cast("bigint").alias("best_round"),
        F.array().cast("array<string>").alias("strategies"),
        F.when(F.col("n").isNull(), "global_fallback").alias("reason"),
    )
    state = settle(state)
    asks = near.join(queries, "qid").select("qid", F.lit(0).alias("part"), "scope", depth[F.col("tier")].alias("depth"), "ask")
    whole = state.where("reason IS NOT NULL").join(queries, "qid").select("qid", F.lit(0).alias("part"), F.lit(None).cast("string").alias("scope"), F.lit(DEPTHS["HIGH"]).alias("depth"), "ask")
    evidence = settle(search(asks.unionByName(whole)).groupBy("qid", "id").agg(F.max("sim").alias("sim")))
    for round_ in range(rounds):
        open_ = state.where("reason IS NULL")
        if open_.isEmpty():
            break
        held = evidence.join(open_.select("qid"), "qid", "left_semi")
        left = F.lit(seconds) - call_seconds * F.col("calls")
        marks = judge(held).select("qid", "coverage", "validity")
        now = state.join(marks, "qid", "left").withColumns({"coverage": F.coalesce("coverage", F.lit(0)), "validity": F.coalesce("validity", F.lit(0)), "left": left})
        now = now.withColumn("quality", F.expr("(coverage + validity) div 2")).withColumn("how", strategy(F.col("coverage") / MICRO, F.col("validity") / MICRO, F.col("left")))
        judged = F.col("reason").isNull() & (F.col("left") >= LEAST_SECONDS)
        flat = F.col("previous").isNotNull() & (F.abs(F.col("quality") - F.col("previous")) < LEAST_GAIN)
        ends = (
            F.when(F.col("reason").isNotNull(), F.col("reason"))
            .when(F.col("left") < LEAST_SECONDS, "time_budget")
            .when(F.col("quality") >= GOOD, "quality_threshold")
            .when(flat, "stagnation")
            .when(F.col("how") == "Stop", "stop_strategy")
        )
        chose = judged & (F.col("quality") < GOOD) & ~flat
        better = judged & (F.col("quality") > F.col("best"))
        now = settle(
            now.select(
                "qid", "calls", "left", "how",
                F.when(judged, round_ + 1).otherwise(F.col("rounds")).cast("bigint").alias("rounds"),
                F.when(judged, F.col("quality")).otherwise(F.col("previous")).alias("previous"),
                F.when(better, F.col("quality")).otherwise(F.col("best")).alias("best"),
                F.when(better, round_).otherwise(F.col("best_round")).cast("bigint").alias("best_round"),
                F.when(chose, F.array_append("strategies", F.col("how"))).otherwise(F.col("strategies")).alias("strategies"),
                ends.alias("reason"),
            )
        )
        go = now.where("reason IS NULL")
        deep, wide = F.col("how").isin("Depth", "Hybrid") & F.col("tier").isin("HIGH", "MODERATE"), F.col("how").isin("Breadth", "Hybrid") & (F.col("tier") == "POTENTIAL")
        numbered = tiers.withColumn("no", F.row_number().over(Window.partitionBy("qid", "tier").orderBy("place")))
        scopes = numbered.join(go.select("qid", "how", "left"), "qid").where(deep | (wide & (F.col("no") <= MOST_EXPANDED)))
        scopes = scopes.withColumn("no", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).where(F.col("no") <= MOST_SCOPES)
        parts = follow(held, queries.join(go.select("qid"), "qid", "left_semi")).where(F.col("part") <= MOST_FOLLOW_UPS)
        calls = scopes.join(parts, "qid").withColumn("call", F.row_number().over(Window.partitionBy("qid").orderBy("part", "no")) - 1)
        calls = settle(calls.where(F.col("left") - call_seconds * F.col("call") >= LEAST_SECONDS).select("qid", "part", "scope", depth[F.col("tier")].alias("depth"), "ask"))
        evidence = settle(_best_of(evidence, search(calls)))
        made = calls.groupBy("qid").agg(F.count("*").alias("made"))
        state = settle(now.drop("left", "how").join(made, "qid", "left").withColumn("calls", F.col("calls") + F.coalesce("made", F.lit(0))).drop("made"))
    done = state.select("qid", "rounds", F.coalesce("reason", F.lit("rounds")).alias("reason"), F.array_join("strategies", ",").alias("strategies"), F.when(F.col("best") >= 0, F.col("best") / MICRO).alias("quality"), "best_round", "calls")
    return done, evidence


FINAL, CALL = r"(?is)Final\s+Answer:\s*(.*)", r"(?s)Action:\s*([a-zA-Z_]+)\s*\(\s*(\{.*?\})\s*\)"


def called(text: Column) -> Column:
    """``Action: tool({"query": ...})`` as (tool, query, year); arguments that are no JSON are the query; null without a call."""
    name, raw = F.regexp_extract(text, CALL, 1), F.regexp_extract(text, CALL, 2)
    args = F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.replace(raw, F.lit("'"), F.lit('"'))))
    field = lambda k, kind: F.try_variant_get(args, f"$.{k}", kind)
    query = F.when(args.isNull(), raw).otherwise(F.coalesce(field("query", "string"), F.lit("")))
    return F.when(name != "", F.struct(name.alias("tool"), query.alias("query"), field("year", "int").alias("year")))


def react(questions: DataFrame, search: Callable[[DataFrame], DataFrame], tools: dict[str, str], make: Callable[[], LanguageModel] = Extractive, rounds: int = 6) -> DataFrame:
    """Reason, act, observe, for all questions (qid, question) in rounds of one model batch and one search batch.

    Each round the model continues every open question's transcript. A final answer closes the question; a call is
    sent to the scope of its tool (``tools``: name to scope, general tools to an empty one); an unknown tool finds
    nothing; a reply with neither is told what to emit. ``search`` maps (qid, scope, query, year) to (qid, id, rank,
    text), scope null for all. Questions that are open after the last round are asked for their answer once more.

    Returns (qid, iterations, model_calls, reason, answer, tools, ids): reason is final_answer or max_iters, tools
    the calls in order, ids what was found, each once at its first place.
    """
    known = F.create_map(*[x for name, scope in tools.items() for x in (F.lit(name), F.lit(scope))])
    state = questions.select(
        "qid",
        F.concat(F.lit("Question: "), "question", F.lit("\n\nBegin.")).alias("transcript"),
        F.lit(0).cast("bigint").alias("iterations"),
        F.lit(None).cast("string").alias("answer"),
        F.array().cast("array<string>").alias("tools"),
    )
    state, chunks = settle(state), []
    for round_ in range(rounds):
        open_ = state.where("answer IS NULL")
        if open_.isEmpty():
            break
        said = generate(open_.select("qid", "transcript"), "transcript", make)
        reply = F.coalesce("answer", F.lit(""))
        final = F.when(reply.rlike(FINAL), F.trim(F.regexp_extract(reply, FINAL, 1)))
        turn = settle(said.select("qid", reply.alias("reply"), final.alias("final"), F.when(final.isNull(), called(reply)).alias("call")))
        asks = turn.where("call IS NOT NULL").select("qid", known[F.col("call.tool")].alias("scope"), "call.query", "call.year").where("scope IS NOT NULL")
        found = settle(search(asks.withColumn("scope", F.nullif("scope", F.lit("")))).select("qid", "id", F.col("rank").cast("bigint").alias("rank"), "text"))
        chunks.append(found.select("qid", "id", F.lit(round_).alias("round"), "rank"))
        seen = found.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "text"))), lambda x: F.concat(F.lit("["), x["id"].cast("string"), F.lit("] "), F.coalesce(x["text"], F.lit("")))), "\n").alias("observation"))
        told = F.when(F.col("call").isNull(), "You must emit either an Action: tool(...) or a Final Answer:.").otherwise(F.concat(F.lit("Observation:\n"), F.coalesce("observation", F.lit(""))))
        step = turn.join(seen, "qid", "left").select("qid", F.concat(F.lit("\n\n"), "reply", F.lit("\n\n"), told).alias("more"), "final", F.col("call.tool").alias("tool"))
        state = settle(
            state.join(step, "qid", "left").select(
                "qid",
                F.concat("transcript", F.coalesce("more", F.lit(""))).alias("transcript"),
                (F.col("iterations") + F.col("more").isNotNull().cast("bigint")).alias("iterations"),
                F.coalesce("answer", "final").alias("answer"),
                F.when(F.col("tool").isNotNull(), F.array_append("tools", F.col("tool"))).otherwise(F.col("tools")).alias("tools"),
            )
        )
    forced = state.where("answer IS NULL").select("qid", F.concat("transcript", F.lit("\n\nStop. Emit Final Answer: now.")).alias("transcript"))
    last = generate(forced, "transcript", make).select("qid", F.trim(F.coalesce("answer", F.lit(""))).alias("last"))
    last = last.select("qid", F.when(F.col("last").rlike(FINAL), F.trim(F.regexp_extract("last", FINAL, 1))).otherwise(F.col("last")).alias("forced"))
    every = chunks[0] if chunks else questions.select("qid", F.lit(None).cast("bigint").alias("id"), F.lit(0).alias("round"), F.lit(0).cast("bigint").alias("rank")).where("false")
    for c in chunks[1:]:
        every = every.union(c)
    places = every.groupBy("qid", "id").agg(F.min(F.struct("round", "rank")).alias("at"))
    ids = places.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("x")).select("qid", F.col("x.id").alias("ids"))
    closed = F.col("answer").isNotNull()
    return state.join(last, "qid", "left").join(ids, "qid", "left").select(
        "qid", "iterations",
        (F.col("iterations") + (~closed).cast("bigint")).alias("model_calls"),
        F.when(closed, "final_answer").otherwise("max_iters").alias("reason"),
        F.coalesce("answer", "forced").alias("answer"),
        "tools",
        F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"),
    )
