"""Hand cases for retrieval, metrics, segmentation, parsing, sources and streams."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopelens.functions import parsing
from scopelens.functions import text as tx
from scopelens.operators import chunking, dense, fusion, metrics, systems
from scopelens.operators.aggregates import with_position
from scopelens.sources import crawl, files
from scopelens.streaming import events as ev


def test_reciprocal_rank_fusion(spark):
    lists = spark.createDataFrame([(1, 1, 1, 1.0), (1, 2, 2, 1.0), (1, 3, 3, 1.0), (1, 2, 1, 1.0), (1, 4, 2, 1.0)], "qid int, id int, rank int, w double")
    got = [(r.id, r.score) for r in fusion.rrf(lists, 4).orderBy("rank").collect()]
    assert got == [(2, 0.032522), (1, 0.016393), (4, 0.016129), (3, 0.015873)]


def test_hybrid_merge_drops_what_does_not_fit(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "item_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 12, 1)], "item_id int, doc_id int, rank int")
    assert [r.doc_id for r in fusion.hybrid_merge([a, b], 2).orderBy("pos").collect()] == [10, 11]


def test_interleave_deals_the_remainder_first(spark):
    rows = [(1, no, no * 100 + r, r) for no in range(1, 5) for r in range(1, 10)]
    got = fusion.interleave(spark.createDataFrame(rows, "qid int, no int, id int, rank int"), 15, 4).collect()
    assert sorted(sum(1 for r in got if r.id // 100 == n) for n in range(1, 5)) == [3, 4, 4, 4]


def test_rank_metrics(spark):
    rel = [0, 1, 0, 1] + [0] * 6
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(rel, 1)], "q int, rank int, rel int")
    r = metrics.at_k(df, "q").first()
    assert (r.p, r.hit, r.mrr, r.ndcg) == (0.2, 1, 0.5, 0.650921)


def test_answer_metrics(spark):
    df = spark.createDataFrame([(1, "The Eiffel Tower, in Paris.", "eiffel tower"), (2, "", "x"), (3, "a", "the")], "k int, p string, g string")
    from pyspark.sql import functions as F

    got = df.select("k", metrics.exact_match(F.col("p"), F.col("g")).alias("em"), metrics.contains_answer(F.col("p"), F.col("g")).alias("c"), metrics.window_match(F.col("p"), F.col("g")).alias("w")).orderBy("k").collect()
    assert [(r.em, r.c, r.w) for r in got][:2] == [(0, 1, 1), (0, 0, 0)]
    f1 = {r.k: r.f1 for r in metrics.token_f1(df, ["k"], "p", "g").collect()}
    assert f1 == {1: 0.666667, 2: 0.0, 3: 1.0}


def test_dense_scopes_and_ties(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [0.0, 1.0], "a")], "id bigint, v array<double>, scope string")
    q = spark.createDataFrame([(9, [1.0, 0.0], None), (8, [1.0, 0.0], "a")], "qid bigint, v array<double>, scope string")
    got = {(r.qid, r["rank"]): r.id for r in dense.topk(q, c, 2).collect()}
    assert got == {(9, 1): 1, (9, 2): 2, (8, 1): 1, (8, 2): 3}
    assert dense.topk(q, c.where("id > 9"), 2).count() == 0


@pytest.mark.parametrize("text", ["", "short", "a b " * 900, "para one\n\npara two " * 200, "x" * 2500])
def test_recursive_chunks_fit_and_keep_words(text):
    chunks = chunking.split_recursive(text)
    assert all(0 < len(c) <= 1000 for c in chunks)
    assert set("".join(text.split())) == set("".join("".join(chunks).split()))


def test_three_sentence_groups(spark):
    df = spark.createDataFrame([(1, ". ".join(f"sentence number {i} is long enough" for i in range(7)))], "k int, t string")
    assert [r.chunk.count("sentence") for r in chunking.sentence_groups(df, "k", "t", least=0).orderBy("part").collect()] == [3, 3, 1]


def test_parsing(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('x {"c": 1} y', '<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call>'), ("none", "<tool_call>bad</tool_call>")], "a string, b string")
    got = df.select(parsing.verdict(F.col("a"), "c").alias("v"), parsing.tool_calls(F.col("b")).alias("t")).collect()
    assert [r.v for r in got] == [1, 0]
    assert [len(r.t) for r in got] == [1, 0]


def test_position_of_sorted_rows(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 9, 3)], "k bigint")
    assert {r.k: r.position for r in with_position(df, "k").collect()} == {1: 0, 3: 1, 5: 2, 9: 3}


def test_failing_model_leaves_the_error(spark):
    class Broken:
        def generate(self, prompts):
            raise ValueError("no")

    r = systems.generate(spark.createDataFrame([("p",)], "prompt string"), "prompt", make=Broken).first()
    assert r.answer is None
    assert "ValueError" in r.error


def test_near_duplicate_suppression(spark):
    df = spark.createDataFrame([(1, 1, 1, [1.0, 0.0]), (1, 2, 2, [1.0, 0.01]), (1, 3, 3, [0.0, 1.0])], "qid bigint, id bigint, rank bigint, v array<double>")
    assert sorted(r.id for r in systems.suppress_near_duplicates(df).collect()) == [1, 3]


def test_jsonl_skips_bad_lines_and_errors(spark, tmp_path):
    lines = [json.dumps({"query_id": "1", "system": "a"}), "{broken", json.dumps({"query_id": "2", "system": "a", "error": "x"})]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    with gzip.open(tmp_path / "s.jsonl.gz", "wt") as f:
        f.write(lines[0])
    assert files.read_jsonl(spark, str(tmp_path / "r.jsonl")).count() == 1
    assert files.read_jsonl(spark, str(tmp_path / "s.jsonl.gz")).count() == 1
    (tmp_path / "q.json").write_text(json.dumps([{"query_id": "1", "query": "x"}, {"query_id": "2"}]))
    assert files.read_suite(spark, str(tmp_path / "q.json")).count() == 2


def test_append_resumes_and_retries(spark, tmp_path):
    path = str(tmp_path / "sink")
    first = spark.createDataFrame([("1", None), ("2", "boom")], "id string, error string")
    files.append_new(first, path, ["id"])
    files.append_new(spark.createDataFrame([("1", None), ("2", None), ("3", None)], "id string, error string"), path, ["id"])
    got = sorted((r.id, r.error) for r in spark.read.parquet(path).where("error IS NULL").collect())
    assert got == [("1", None), ("2", None), ("3", None)]


def test_sinks_upserts_and_missing_sources(spark, tmp_path):
    df = spark.createDataFrame([("a_b", None), ("c", 0.5)], "k string, x double")
    assert "---" in files.markdown(df)
    assert files.latex(df).startswith(r"a\_b & ---")
    assert files.read_or_empty(spark, str(tmp_path / "nothing"), "a int").count() == 0
    assert {r.k: r.x for r in files.upsert(df, spark.createDataFrame([("c", 2.0)], "k string, x double"), ["k"]).collect()} == {"a_b": None, "c": 2.0}
    for name, data in (("a.pdf", b"%PDF-1"), ("b.pdf", b"oops"), ("c.txt", b"%PDF-1")):
        (tmp_path / name).write_bytes(data)
    got = files.page_texts(spark, f"{tmp_path}/*.*", {".pdf": b"%PDF"}).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.pdf"]


def test_crawl_levels(spark):
    page = lambda i, *to: (i, f"http://h/{i}", "".join(f'<a href="{x}">' for x in to))
    pages = spark.createDataFrame([page(1, "/2", "http://other/9"), page(2, "3#frag"), page(3, "/4")], "page_id int, url string, html string")
    got = {r.url: r.depth for r in crawl.crawl(pages, spark.createDataFrame([("http://h/1",)], "url string"), 2).collect()}
    assert got == {"http://h/1": 0, "http://h/2": 1, "http://h/3": 2}


def test_text_functions(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(tx.slug(F.lit("  A b--C! ")).alias("s"), tx.title_bucket(F.lit(" zed")).alias("b"), F.array_join(tx.pack_sentences(F.lit("One. Two three. Four."), 12), "|").alias("p"), tx.compose_label(F.lit(" a  b"), F.lit("c")).alias("l")).first()
    assert (r.s, r.b, r.p, r.l) == ("a_b_c", "T-Z", "One.|Two three.|Four.", "A B::C")


def test_streams(spark, sf_dir, tmp_path):
    folder = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(str(folder))
    stream = lambda: ev.read_events(spark, str(folder), per_trigger=10)
    n = spark.read.parquet(str(folder)).count()
    assert ev.run_to_memory(ev.unique_events(stream()), "t_unique").count() == n
    whole = ev.run_to_memory(ev.tumbling_counts(stream()), "t_tumbling", "complete")
    assert whole.selectExpr("sum(n)").first()[0] == n
    assert ev.run_to_memory(ev.sliding_means(stream()), "t_sliding", "complete").count() > 0
    assert ev.run_to_memory(ev.sessions(stream()), "t_sessions", "complete").selectExpr("sum(n)").first()[0] == n
    totals = ev.run_to_memory(ev.running_totals(stream()), "t_totals", "update")
    assert totals.selectExpr("sum(n)").first()[0] == n
    for _ in range(2):
        ev.append_once(stream(), str(tmp_path / "sink"), str(tmp_path / f"cp{_}")).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == n


def test_models_are_saved_and_loaded(spark, tmp_path):
    from scopelens.operators import models

    df = spark.createDataFrame([([float(i % 2), 1.0 - i % 2], i % 2) for i in range(40)], "v array<double>, label int")
    models.save(models.fit_router(df), str(tmp_path / "m"))
    got = models.route(models.load(str(tmp_path / "m")), df, k=2).collect()
    assert all(r.scopes[0].scope == r.label and r.scopes[0].confidence >= r.scopes[1].confidence for r in got)


def test_subsets_are_partitioned(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "doc_id int, text string")
    keep = spark.createDataFrame([(2, 1, 0), (2, 1, 3), (2, 2, 4)], "size int, seed int, doc_id int")
    files.write_subsets(rows, keep, "doc_id", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("seed = 1").count() == 2


def test_command_line_lists_queries(capsys, monkeypatch):
    from scopelens import __main__ as cli

    monkeypatch.setattr("sys.argv", ["scopelens", "list"])
    cli.main()
    assert "knn_purity_by_label" in capsys.readouterr().out


def test_robots_rules_by_group_and_length(spark):
    body = "Allow: /before\r\nUser-agent: a\r\nUser-agent: scope\r\n\r\nDisallow: /x # all of it\nAllow: /x/y\nDisallow: /*.pdf$\nDisallow: /q?z=(1)\nUser-agent: *\nDisallow: /\nUser-agent: Lens\nDisallow: /lens\nAllow:\n"
    robots = spark.createDataFrame([("h", body), ("open", "User-agent: *\nDisallow:\n"), ("shut", "user-agent: *\ndisallow: /"), ("tie", "User-agent: *\nDisallow: /ab\nAllow: /ab"), ("none", None)], "host string, body string")
    urls = ["http://h/", "http://h/before", "http://h/x", "http://h/xx?a", "http://h/x/y/z", "http://h/f.pdf", "http://h/f.pdfs", "http://h/q?z=(1)&b", "http://h/q", "http://h/lens/1", "http://open/x", "http://shut/a", "http://shut", "http://tie/abc", "http://none/x", "http://unknown/x"]
    table = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url for r in crawl.permitted(table, crawl.robots_rules(robots, "ScopeLens/1.0")).collect()}
    assert set(urls) - got == {"http://h/x", "http://h/xx?a", "http://h/f.pdf", "http://h/q?z=(1)&b", "http://h/lens/1", "http://shut/a", "http://shut"}
    general = {r.url for r in crawl.permitted(table, crawl.robots_rules(robots, "somebody")).collect()}
    assert not any(u.startswith("http://h/") for u in general) and "http://open/x" in general


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("ties", [False, True])
def test_nearest_of_scopes_and_of_all(spark, monkeypatch, small, ties):
    """Lists are those of all pairs however queries and rows are dealt; several lists a query, repeated ids and null scopes included."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50 if small else 10_000)
    monkeypatch.setattr(dense, "LISTED", 64 if small else dense.LISTED)
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(700, 6)), 1)
    rows = [(int(i % 690), v[i].tolist(), None if i % 11 == 0 else f"s{i % 4}") for i in range(700)]
    asked = [(i, v[i].tolist(), s, n) for i in range(0, 600, 2) for s, n in ((None, "g"), (f"s{i % 3}", "a"), ("s9", "none"))]
    corpus = spark.createDataFrame(rows, "id bigint, v array<double>, scope string")
    queries = spark.createDataFrame(asked, "qid bigint, v array<double>, scope string, list string")
    want = set()
    for q, x, s, n in asked:
        sims = sorted((-round(float(np.dot(x, y)), 6) + 0.0, i) for i, y, t in rows if i != q and (s is None or t == s))
        for place, (sim, i) in enumerate(sims, 1):
            rank = 1 + sum(o < sim for o, _ in sims) if ties else place
            if rank <= 5:
                want.add((q, n, i, round(-sim, 5) + 0.0, None if not ties else rank))
    got = {(r.qid, r.list, r.id, round(r.sim, 5) + 0.0, None if not ties else r["rank"]) for r in dense.topk(queries, corpus, 5, exclude_self=True, ties=ties).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_a_scoped_search_sends_a_row_to_its_scope_only(spark):
    """A query meets the rows of its part, and no list leaves a cell longer than it may be."""
    corpus = spark.range(4000).selectExpr("id", "array(cast(id % 7 as double), 1D) AS v", "cast(id % 40 as string) AS scope")
    queries = corpus.withColumnRenamed("id", "qid")
    both, cells = dense._spread(dense._shape(corpus, "id"), dense._shape(queries, "qid"), 3)
    met = both.where("kind = 0").select("cell", "scope").distinct().join(both.where("kind = 1").select("cell", F.col("scope").alias("of")), "cell")
    assert cells > 1 and met.count() < 4000 * 40 // 4 and dict(both.dtypes)["v"] == "array<float>"
