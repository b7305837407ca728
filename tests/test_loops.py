"""Loops over all queries at once: why they end, what they call, and what they keep."""

import pytest
from pyspark.sql import functions as F

from scopelens.operators import loops

STATES = "qid bigint, rounds bigint, reason string"


class Script:
    """Replies by question: a list of what to say in each round."""

    SAYS = {
        "a": ["Final Answer: at once\nand more"],
        "b": ['Thought.\nAction: find({"query": "x", "year": 2001})', "final answer:  two "],
        "c": ["no idea", "Action: find({'query': 'single'})", "Action: find({broken})", "Action: gone({\"query\": \"y\"})", "Final Answer: after all"],
        "d": ['Action: all({"query": "z"})'] * 9,
        "e": ["hm"] * 6 + ["just a guess"],
        "f": [None] * 7,
    }

    def generate(self, prompts):
        out = []
        for p in prompts:
            says = self.SAYS[p.removeprefix("Question: ")[0]]
            step = p.count("Observation:\n") + p.count("You must emit either")
            out.append("Final Answer: forced" if p.endswith("Answer: now.") and says[-1] and says[-1].startswith("Action") else says[min(step, len(says) - 1)])
        return out


def test_reasoning_rounds(spark):
    asked = []

    def search(asks):
        asked.extend(asks.collect())
        two = asks.select("qid", F.explode(F.array(F.lit(5).cast("bigint"), F.lit(3).cast("bigint"))).alias("id"), "scope", "query")
        return two.select("qid", F.when(F.col("query") == "single", F.col("id") + 10).otherwise(F.col("id")).alias("id"), F.when(F.col("id") == 5, 1).otherwise(2).alias("rank"), F.lit("text").alias("text"))

    q = spark.createDataFrame([(i, k) for i, k in enumerate("abcdef")], "qid bigint, question string")
    got = {r.qid: r for r in loops.react(q, search, {"find": "scope", "all": ""}, Script).collect()}
    assert [got[i].reason for i in range(6)] == ["final_answer"] * 3 + ["max_iters"] * 3
    assert [got[i].iterations for i in range(6)] == [1, 2, 5, 6, 6, 6] and [got[i].model_calls for i in range(6)] == [1, 2, 5, 7, 7, 7]
    assert [got[i].answer for i in range(6)] == ["at once\nand more", "two", "after all", "forced", "just a guess", ""]
    assert got[2].tools == ["find", "find", "gone"] and got[3].tools == ["all"] * 6
    assert got[1].ids == [5, 3] and got[2].ids == [15, 13, 5, 3] and got[4].ids == []
    by = {(r.qid, r.query): (r.scope, r.year) for r in asked}
    assert by == {(1, "x"): ("scope", 2001), (2, "single"): ("scope", None), (2, "{broken}"): ("scope", None), (3, "z"): (None, None)}


def test_no_question_no_answer(spark):
    none = spark.createDataFrame([], "qid bigint, question string")
    assert loops.react(none, lambda asks: asks.selectExpr("qid", "1L AS id", "1 AS rank", "'' AS text"), {"find": "s"}, Script).collect() == []


def refined(spark, marks, tiers, **more):
    """marks: coverage and validity of each query by round."""
    calls, seen = [], []
    q = spark.createDataFrame([(i, f"q{i}") for i in range(len(marks))], "qid bigint, ask string")
    t = spark.createDataFrame(tiers, "qid bigint, scope string, tier string, place int")

    def search(asks):
        calls.append(sorted(map(tuple, asks.collect()), key=str))
        return asks.selectExpr("qid", "cast(abs(hash(coalesce(scope, ''), ask)) % 1000 as bigint) AS id", "500000L AS sim")

    def judge(held):
        i = len(seen)
        seen.append(i)
        rows = [(n, *marks[n][min(i, len(marks[n]) - 1)]) for n in range(len(marks))]
        return held.select("qid").distinct().join(spark.createDataFrame(rows, "qid bigint, coverage bigint, validity bigint"), "qid")

    follow = lambda held, asked: asked.select("qid", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("part"), "ask")
    states, evidence = loops.refine(q, t, search, judge, follow, **more)
    return {r.qid: r for r in states.collect()}, calls, evidence


def test_why_a_refinement_ends(spark):
    m = 10_000
    marks = [
        [(90 * m, 85 * m)],  # good enough at once
        [(60 * m, 60 * m), (62 * m, 62 * m)],  # no gain
        [(80 * m, 75 * m)],  # nothing to be done
        [(10 * m, 10 * m), (40 * m, 20 * m), (55 * m, 45 * m), (70 * m, 62 * m)],  # rounds run out
        [(50 * m, 50 * m)],  # no scope is near: answered from everything
    ]
    tiers = [(i, s, tier, p) for i in range(4) for s, tier, p in (("x", "HIGH", 1), ("y", "MODERATE", 2), ("u", "POTENTIAL", 3), ("v", "POTENTIAL", 4), ("w", "POTENTIAL", 5), ("z", "IRRELEVANT", 6))]
    tiers.append((4, "x", "POTENTIAL", 1))
    got, calls, _ = refined(spark, marks, tiers, rounds=3, seconds=900)
    assert [got[i].reason for i in range(5)] == ["quality_threshold", "stagnation", "stop_strategy", "rounds", "global_fallback"]
    assert [got[i].rounds for i in range(5)] == [1, 2, 1, 3, 0]
    assert got[3].strategies == "Hybrid,Hybrid,Hybrid" and got[2].strategies == "Stop" and got[1].strategies == "Hybrid"
    assert got[3].quality == pytest.approx(0.5) and got[3].best_round == 2 and got[4].quality is None
    assert got[3].calls == 2 + 3 * 8 and got[0].calls == 2 and got[4].calls == 1  # two follow-ups in four scopes each round
    assert {c[2:4] for c in calls[0] if c[0] == 3} == {("x", 20), ("y", 5)} and {c[2:4] for c in calls[0] if c[0] == 4} == {(None, 20)}
    assert {c[1:4] for c in calls[1] if c[0] == 3} == {(p, s, d) for p in (1, 2) for s, d in (("x", 20), ("y", 5), ("u", 5), ("v", 5))}


def test_time_ends_calls_and_rounds(spark):
    tiers = [(0, s, tier, p) for s, tier, p in (("x", "HIGH", 1), ("y", "MODERATE", 2), ("u", "POTENTIAL", 3))]
    got, calls, _ = refined(spark, [[(0, 0), (20 * 10_000, 0), (40 * 10_000, 0)]], tiers, rounds=9, seconds=40, call_seconds=6)
    # 28 seconds are left for the first round: calls begin at 28, 22, 16 and 10; then 4 are left.
    assert len(calls[1]) == 4 and got[0].reason == "time_budget" and got[0].rounds == 1 and got[0].calls == 6


def test_deeper_or_wider(spark):
    m = 10_000
    tiers = [(i, s, tier, p) for i in range(2) for s, tier, p in (("x", "HIGH", 1), ("u", "POTENTIAL", 2))]
    _, calls, evidence = refined(spark, [[(10 * m, 90 * m)], [(90 * m, 10 * m)]], tiers, rounds=1)
    assert {(c[0], c[2]) for c in calls[1]} == {(0, "x"), (1, "u")}
    assert evidence.groupBy("qid", "id").count().where("count > 1").isEmpty()
