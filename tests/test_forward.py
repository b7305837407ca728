"""Searches over forward rows give what joins on terms give, however queries are dealt, and shuffle no pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scopelens.operators import backends, forward, lexical
from scopelens.sources.indexes import TextIndex


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"t{i}" for i in (rng.pareto(1.0, int(rng.integers(1, 80))) * 3).astype(int) % 200) for _ in range(400)] + ["t1 t2 copy"] * 150 + [None, ""]
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)], "doc_id bigint, text string, source string").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"t{i}" for i in rng.integers(0, 60, 12)) for _ in range(40)] + ["t1 copy", "none of these", None, "t2 t2 t2"]
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)], "item_id bigint, text string, source string")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("forward") / "t")
    TextIndex.build(docs, path, scopes=("source",))
    return TextIndex(spark, path)


def as_set(df):
    return {(r.item_id, r.doc_id, r.score, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("dealt", [False, True])
@pytest.mark.parametrize("scope", [None, "source"])
def test_the_best_are_those_of_all_scores(index, docs, queries, monkeypatch, dealt, scope):
    if dealt:
        monkeypatch.setattr(forward, "ASKED_ROWS", 10)
        monkeypatch.setattr(forward, "SHARD_DOCS", 100)
        monkeypatch.setattr(forward, "BLOCK_WEIGHTS", 60)
    want = lexical.ranked(lexical.bm25_scores(queries, docs, scope=scope), "item_id", "doc_id", 7)
    assert as_set(index.topk(queries, 7, scope=scope)) == as_set(want) != set()


def test_small_matrices_change_nothing(index, docs, queries, monkeypatch):
    want = as_set(index.topk(queries, 7))
    monkeypatch.setattr(forward, "CELLS", 500)
    monkeypatch.setattr(forward, "BLOCK_QUERIES", 3)
    assert as_set(index.topk(queries, 7)) == want


def test_a_search_shuffles_its_best_only(index, queries):
    plan = index.topk(queries, 7)._jdf.queryExecution().executedPlan().toString()
    exchange = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(exchange) == 1 and "item_id" in exchange[0] and "doc_id" not in exchange[0]


@pytest.mark.parametrize("indexed", [False, True])
def test_sparse_weights(index, docs, queries, indexed):
    q = lexical.tfidf_weights(queries, "item_id")
    want = lexical.sparse_topk(q, lexical.tfidf_weights(docs, "doc_id"), 9)
    assert as_set(backends.Sparse(docs, index if indexed else None).search(queries, 9)) == as_set(want)


def test_null_scopes_see_all_in_a_backend(index, docs, queries):
    asked = queries.withColumnRenamed("source", "scope")
    some = lexical.bm25_scores(queries.where("source IS NOT NULL"), docs, scope="source")
    every = lexical.bm25_scores(queries.where("source IS NULL"), docs)
    want = as_set(lexical.ranked(some.unionByName(every), "item_id", "doc_id", 5))
    assert as_set(backends.Lexical(index, "source").search(asked, 5)) == want
    kept = backends.Kept(backends.Lexical(index, "source"), 5)
    assert as_set(kept.search(asked, 5)) == want and as_set(kept.search(asked, 2)) == {x for x in want if x[3] <= 2}


def test_rows_count_words(docs):
    got = {r.doc_id: (r.dl, dict(zip(r.terms, r.tfs, strict=True))) for r in forward.rows(docs, "doc_id").collect()}
    assert len(got) == 552 and got[550] == (None, {}) and got[551] == (0, {})
    want = {(r.doc_id, r.term): r.tf for r in lexical.postings(docs, "doc_id").collect()}
    assert {(d, t): n for d, (_, tf) in got.items() for t, n in tf.items()} == want


def test_an_empty_corpus(spark, queries, tmp_path):
    TextIndex.build(spark.createDataFrame([], "doc_id bigint, text string"), f"{tmp_path}/t")
    assert TextIndex(spark, f"{tmp_path}/t").topk(queries.select("item_id", "text"), 3).collect() == []


@pytest.mark.parametrize("dealt", [False, True])
def test_whole_texts_in_documents(spark, monkeypatch, dealt):
    monkeypatch.setattr(lexical, "SMALL_QUERIES", 0 if dealt else 20_000)
    docs = spark.createDataFrame([(1, "x one two three y", "a"), (2, "zone two three y", "b"), (3, None, "a"), (4, "one two\nthree", "a"), (5, "one two three", None)], "doc_id bigint, text string, source string")
    q = spark.createDataFrame([(1, "one two three"), (2, "x one"), (3, None), (4, "absent words here"), (5, "x one two three y")], "item_id bigint, text string")
    got = lexical.containing(q, docs, keep=("source",))
    assert {tuple(r) for r in got.collect()} == {(1, 1, "a"), (1, 2, "b"), (1, 5, None), (5, 1, "a")}
    assert dealt or "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_words_between_spaces():
    """What is found by bytes is what a split by single spaces gives, and little else is looked at."""
    texts = ["ab  é ab", None, "", " b\n ab", "x" * 70 + " " + "y" * 90, "é"] + ["word wxyd other"] * 3
    arr = pa.array(["cut", *texts]).slice(1)
    for words in ({"ab", "é", "", "x" * 70}, {"b\n", "y" * 90, "none"}, {"word"}, set()):
        asked = {w.encode() for w in words}
        met = [(i, w, bytes(t)) for i, w, t in forward.spaced(arr, forward.marks(asked))]
        want = [(i, w.encode(), (t or "").encode()) for i, t in enumerate(texts) for w in (t or "").split(" ") if w in words]
        assert [x for x in met if x[1] in asked] == want
    assert [w for _, w, _ in forward.spaced(arr, forward.marks([b"word"]))] == [b"word"] * 3


def test_words_of_texts_that_touch():
    """Texts lie end to end in a batch, but a word ends with its text."""
    texts = ["ab", "cd", "", "-", "é1 x_", "2"]
    doc, words = forward._words(pa.array(["zz", *texts], pa.large_string()).slice(1))
    assert list(zip(doc.tolist(), words.to_pylist(), strict=True)) == [(0, "ab"), (1, "cd"), (4, "1"), (4, "x_"), (5, "2")]


def test_evaluation_shuffles_no_document(spark, sf_dir):
    """Every exchange of the plan carries ids and what is said of them; all scores and texts stay where they are."""
    from scopelens.plans import QUERIES

    plan = QUERIES["confusion_diagonal"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "term#" not in plan


def test_a_document_in_several_sets(index, docs, queries):
    has = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("even").alias("has")).union(docs.where("doc_id % 3 = 0").select("doc_id", F.lit("three")))
    asked = queries.select("item_id", "text").withColumn("set", F.explode(F.array(F.lit("even"), F.lit("three"))))
    got = {(r.set, r.item_id, r.doc_id, r.score, r["rank"]) for r in index.topk(asked, 4, scope="set", by=("item_id", "set"), has=has).collect()}
    every = lexical.bm25_scores(queries, docs)
    for name, of in (("even", 2), ("three", 3)):
        assert {x[1:] for x in got if x[0] == name} == as_set(lexical.ranked(every.where(F.col("doc_id") % of == 0), "item_id", "doc_id", 4))


def plan_of(name, spark, sf_dir):
    from scopelens.plans import QUERIES

    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_a_list_of_labels_counts_once_for_each(index, docs, queries):
    """Runs of different scopes and of none are one search; null labels and null wants match nothing."""
    label = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))
    arm = lambda system, want: F.struct(F.lit(system).alias("system"), want.alias("want"))
    third = queries.withColumn("third", F.col("item_id") % 3)
    arms = F.array(arm("all", F.lit(None).cast("string")), arm("source", label("source", "source")), arm("third", label("third", "third")))
    asked = third.select("item_id", "text", F.explode(arms).alias("arm")).select("item_id", "text", "arm.*").where("want IS NOT NULL OR system = 'all'")
    has = F.array(label("source", "source"), F.concat(F.lit("third/"), (F.col("doc_id") % 3).cast("string")))
    found = index.topk(asked, 6, scope="want", by=("system", "item_id"), has=has, every=True)
    got = {(r.system, r.item_id, r.doc_id, r.score, r["rank"]) for r in found.collect()}
    every = lexical.bm25_scores(queries, docs)
    of_third = every.join(third.select("item_id", "third"), "item_id").where(F.col("doc_id") % 3 == F.col("third"))
    for name, scores in (("all", every), ("source", lexical.bm25_scores(queries, docs, scope="source")), ("third", of_third)):
        assert {x[1:] for x in got if x[0] == name} == as_set(lexical.ranked(scores, "item_id", "doc_id", 6)) != set(), name


def test_arms_read_the_index_once(spark, sf_dir, monkeypatch):
    from scopelens.plans import evaluation
    from scopelens.plans.registry import Tables

    asked = []
    monkeypatch.setattr(TextIndex, "topk", lambda self, *a, f=TextIndex.topk, **b: asked.append(b) or f(self, *a, **b))
    assert {r.system for r in evaluation.arms(Tables(spark, sf_dir)).select("system").distinct().collect()} == {"monolithic", "by_source", "by_lang"}
    assert len(asked) == 1


@pytest.fixture
def as_if_large(spark):
    """No table is small enough for the planner to send it to every task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["hybrid_routed_system", "regex_scoped_system"])
def test_routed_searches_join_no_documents(spark, sf_dir, monkeypatch, name, as_if_large):
    monkeypatch.setattr(lexical, "SMALL_ROWS", 150)  # fewer than there are documents
    assert "Exchange hashpartitioning(doc_id" not in plan_of(name, spark, sf_dir)


def test_growing_sets_list_a_document_once(spark, sf_dir, monkeypatch):
    from scopelens.plans import QUERIES

    seen = []
    monkeypatch.setattr(TextIndex, "topk", lambda self, *a, f=TextIndex.topk, **b: seen.append(b["has"]) or f(self, *a, **b))
    QUERIES["corpus_growth_curve"](spark, sf_dir)
    assert seen[0].count() == seen[0].select("doc_id").distinct().count() > 0


def test_twins_are_sought_among_what_was_found(spark, sf_dir, as_if_large):
    """No document is shuffled by its text's hash; those found and gold meet within their query."""
    assert "hashpartitioning(h#" not in plan_of("lenient_precision", spark, sf_dir)


def test_a_reranker_reads_words_of_candidates_only(spark, sf_dir):
    plan = plan_of("cross_encoder_rerank", spark, sf_dir)
    texts = [x for x in plan.split("\n") if "regexp_extract_all(lower(substring(text" in x]
    assert not texts, texts


@pytest.mark.parametrize("part", [8 << 20, 7])
def test_words_are_those_of_the_pattern(spark, monkeypatch, part):
    """Words end where texts do; letters outside ASCII part words unless they are lower-cased into it."""
    from scopelens.functions.text import tokens

    monkeypatch.setattr(forward, "TEXT_BYTES", part)
    texts = ["ab", "cd ef", None, "", "x", "É-a_1 Zß", "Kelvin İx", "end ", " a\u0000b\n", "...", "naïve naïve a a", "last"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    want = {r.doc_id: None if r.w is None else sorted(r.w) for r in docs.select("doc_id", tokens("text").alias("w")).collect()}
    got = {r.doc_id: None if r.dl is None else sorted(w for w, n in zip(r.terms, r.tfs, strict=True) for _ in range(n)) for r in forward.rows(docs, "doc_id").collect()}
    assert got == want and all(r.dl == len(want[r.doc_id]) for r in forward.rows(docs, "doc_id").where("dl IS NOT NULL").collect())


@pytest.mark.parametrize("passes", [1, 3])
def test_short_texts_in_documents(spark, monkeypatch, passes):
    """Texts of one or two words, and the empty one, are found inside words too, but not across texts."""
    monkeypatch.setattr(lexical, "SHORT_QUERIES", 20_000 if passes == 1 else 4)
    monkeypatch.setattr(lexical, "HITS", 3)
    docs = spark.createDataFrame([(1, "x one two three y", "a"), (2, "é", None), (3, None, "a"), (4, "", "b"), (5, "stone twofold one two", None)], "doc_id bigint, text string, source string").coalesce(1)
    texts = ["one two three", "one tw", "one two", "x", "é", "", None, "ne", "extraordinary", "yé", "stone twofold", " two three", "stone twofoldx", "one"]
    q = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    got = [tuple(r) for r in lexical.holding(q, docs, keep=("source",)).collect()]
    want = [(i, d.doc_id, d.source) for i, t in enumerate(texts) for d in docs.collect() if t is not None and d.text is not None and t in d.text]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_openings_are_met_once_in_parts(monkeypatch):
    monkeypatch.setattr(forward, "TEXT_BYTES", 3)
    texts = ["abcabcabc", None, "", "bc" * 9, "abcdefghi"]
    begins = [b"a", b"bc", b"abc", b"cab", b"bcb", b"abcdefgh", b"ibc", b""]
    got = [(i, b) for i, b, _ in forward.openings(pa.array(["cut", *texts]).slice(1), begins)]
    assert len(got) == len(set(got)) and set(got) == {(i, b) for i, t in enumerate(texts) for b in begins if t is not None and b in t.encode()}


@pytest.fixture(scope="module")
def short_texts(spark, sf_dir, tmp_path_factory):
    """The tables with benchmark texts of no, one and two words."""
    import pyarrow.parquet as pq

    path = tmp_path_factory.mktemp("short")
    docs, bench = pq.read_table(f"{sf_dir}/documents.parquet"), pq.read_table(f"{sf_dir}/benchmark.parquet")
    words = [w.split(" ") for w in docs.column("text").to_pylist()[:40:4] if w and w.count(" ") > 5]
    texts = [" ".join(w[3 : 4 + i % 2]) for i, w in enumerate(words)] + [""]
    more = pa.table({"item_id": [10_000 + i for i in range(len(texts))], "text": texts}).cast(bench.schema)
    pq.write_table(docs, path / "documents.parquet")
    pq.write_table(pa.concat_tables([bench, more]), path / "benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["chance_and_lift", "confusion_diagonal", "dilution_best_scoped", "failure_cases", "gold_field_ladder", "lenient_precision", "per_query_delta", "recall_at_k_sweep", "same_scope_nongold", "scope_precision_gold_hit"])
def test_gold_of_short_texts(spark, short_texts, name):
    import scopelens.plans as plans
    from tests.oracle import connect, rows
    from tests.test_queries import _close

    want = rows(connect(short_texts).sql(plans.ORACLES[name]).df())
    assert _close(rows(plans.QUERIES[name](spark, short_texts).toPandas()), want)


def test_the_corpus_grows_to_its_whole(spark):
    """The largest set of the curve holds all documents, and sets in between are as large as they say, for ten times 100 documents and more."""
    from scopelens.plans import QUERIES, evaluation
    from scopelens.plans.registry import Tables

    sf = "/root/testdata/sf0.01"
    t = Tables(spark, sf)
    n = t.documents.count()
    sizes, has, rest = evaluation.grown(t)
    assert sizes[0] == 100 and sizes[-1] == n
    marked = t.documents.select("doc_id").join(has, "doc_id", "left").withColumn("has", F.coalesce("has", rest))
    got = {r.h: r.n for r in marked.select(F.explode("has").alias("h")).groupBy("h").agg(F.count("*").alias("n")).collect()}
    for s in (1, 2, 3):
        assert [sum(got[f"{s}/{j}"] for j in range(i + 1)) for i in range(len(sizes))] == [max(z, has.count()) for z in sizes]
    assert {r["size"] for r in QUERIES["corpus_growth_curve"](spark, sf).collect()} == set(sizes)
