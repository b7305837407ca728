"""Stepwise answers, stored evidence, re-chunking, projections, power, and file sources, against plain versions."""

import json

import numpy as np
from pyspark.sql import functions as F

from scopelens.operators import chunking, systems
from scopelens.plans import QUERIES
from scopelens.sources import files


class Fixed:
    """Replies by what the prompt holds."""

    def __init__(self, replies):
        self.replies = replies

    def generate(self, prompts):
        return [next((v for k, v in self.replies.items() if k in p), "") for p in prompts]


def _steps(spark, plans, answers, summary):
    p = spark.createDataFrame(plans, "qid bigint, question string, tasks array<string>")
    search = lambda now: now.select("qid", F.explode(F.array(F.lit(1), F.lit(2))).alias("id"), F.lit("x").alias("text")).withColumn("id", F.col("id").cast("bigint")).withColumn("rank", F.col("id"))
    out = systems.planned_steps(p, search, answerer=lambda: Fixed(answers), summariser=lambda: Fixed(summary))
    return {r.qid: (r.steps, r.reason, r.n_chunks, r.answer) for r in out.collect()}


def test_planned_steps_stop_and_fall_back(spark):
    plans = [(1, "one", ["a1", "b1"]), (2, "two", ["no2", "b2"]), (3, "three", []), (4, "four", ["blob4"]), (5, "five", ["a1"] * 9), (6, "six", None)]
    answers = {
        "no2": '{"analysis": "thought", "answer": "", "success": "No"}', "a1": '{"answer": "first", "success": "Yes"}', "b1": '{"answer": "", "success": "yes"}',
        "blob4": '{"answer": broken',
    }
    got = _steps(spark, plans, answers, {"one": "", "five": '{"answer": "sum"}'})
    assert got[1] == (2, "summary", 2, "first")
    assert got[2] == (1, "step_failed", 2, "thought")
    assert got[3] == got[6] == (0, "empty_plan", 0, "")
    assert got[4] == (1, "summary", 2, "")
    assert got[5] == (6, "summary", 2, "sum")


def test_resynthesis_keeps_order_and_skips_finished(spark):
    runs = spark.createDataFrame([(1, "q1", [5, 3, 9]), (2, "q2", [3]), (3, "q3", []), (4, "q4", None)], "k int, query string, ids array<int>")
    texts = spark.createDataFrame([(3, "T3", "S", 2020, "three"), (5, "T5", "S", None, "five")], "id int, title string, section string, year int, text string")
    got = {r.k: r for r in systems.resynthesise(runs, runs.where("k = 2"), texts, "k").collect()}
    assert sorted(got) == [1, 3, 4]
    assert got[1].context == "[SOURCE 1: T5, S, Year n/a]\nfive\n---\n[SOURCE 2: T3, S, Year 2020]\nthree"
    assert (got[1].n_chunks, got[1].ids, got[1].answer, got[3].n_chunks, got[4].answer) == (2, [5, 3], "q1", 0, "q4")


def test_rechunk_equals_splitting_whole_sources(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i, " ".join(rng.choice(["alpha", "beta", "gamma\n\ndelta"], int(rng.integers(1, 120))))) for s in ("a", "b", "c") for i in range(9)]
    df = spark.createDataFrame([*rows, rows[4], ("a", 50, None), ("d", 0, "short")], "s string, i int, x string")
    want = {s: [(k, c) for k, c in enumerate(chunking.split_recursive("\n".join(x for q, _, x in rows if q == s))) if len(c.strip()) >= 40] for s in "abc"}
    got = {}
    for r in chunking.rechunk(df, "s", "i", "x").orderBy("s", "part").collect():
        got.setdefault(r.s, []).append((r.part, r.chunk))
    assert got == want


def test_pca_projection(spark, sf_dir):
    got = QUERIES["pca_projection"](spark, sf_dir).orderBy("id").toPandas()
    v = np.array([r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()], float)
    _, _, axes = np.linalg.svd(v - v.mean(0), full_matrices=False)
    for i, name in enumerate(("pc1", "pc2")):
        a = axes[i] * np.sign(axes[i][np.abs(axes[i]).argmax()])
        assert np.allclose(got[name], v @ a, atol=1e-4)



def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'he said "no",\nthen left', 0.5), (2, None, None), (3, "", 1.0), (4, "plain\\ back", -2.0)]
    df = spark.createDataFrame(rows, "id int, s string, x double")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), "id int, s string, x double")
    assert sorted(map(tuple, back.collect())) == [(i, s or None, x) for i, s, x in rows]  # an empty text comes back as null


def test_reset_and_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    files.reset(spark, path)
    spark.range(10).write.parquet(path)
    files.reset(spark, path, F.col("id") > 6)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [7, 8, 9]
    for _ in range(2):
        files.reset(spark, path)
        assert spark.read.parquet(path).count() == 0
    out = tmp_path / "rows"
    out.mkdir()

    def insert(batch):
        import uuid

        (out / uuid.uuid4().hex).write_text(json.dumps(batch))

    files.insert_batches(spark.range(0, 1203, 1, 2), insert, 500)
    sent = [json.loads(p.read_text()) for p in out.iterdir()]
    assert sorted(len(b) for b in sent) == [101, 102, 500, 500] and sorted(r["id"] for b in sent for r in b) == list(range(1203))


def test_suites_of_offline_drops(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([
        {"query": "q", "answer": "a", "question_type": "inference", "evidence_list": [{"title": "B"}, {"title": "A"}, {"title": "B"}]},
        {"query": "r", "answer": "b", "question_type": None, "evidence_list": []},
    ]))
    m = files.multihop_suite(spark.read.option("multiLine", True).json(str(tmp_path / "m.json"))).orderBy("query").collect()
    assert [tuple(r) for r in m] == [("q", "a", "inference", ["A", "B"]), ("r", "b", "general", [])]
    (tmp_path / "h.json").write_text(json.dumps([{"question": "q", "answer": "a", "type": "bridge", "level": "hard", "context": {"title": ["T", "U"], "sentences": [["x.", "y."], ["z."]]}, "supporting_facts": {"title": ["U", "T", "U"], "sent_id": [0, 1, 0]}}]))
    h = files.hotpot_suite(spark.read.option("multiLine", True).json(str(tmp_path / "h.json"))).first()
    assert (h.query, h.category, h.question_type, h.gold_titles) == ("q", "bridge", "hard", ["T", "U"])
    assert [tuple(p) for p in h.search_results] == [("T", "x. y."), ("U", "z.")]
