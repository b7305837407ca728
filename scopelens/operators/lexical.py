"""Lexical retrieval: BM25, sparse dot products, and substring counts, as joins on terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keywords, occurrences, tokens
from ..session import settle
from .forward import marks, openings, pieces, spaced

#: Parameters of BM25 Okapi.
K1, B, EPSILON = 1.5, 0.75, 0.25


#: Rows up to which a side is broadcast; it is counted first.
SMALL_ROWS = 200_000
#: Texts up to which all are sent to every task.
SMALL_QUERIES = 20_000
#: Texts of less than three words that are sought in one pass over the documents, and hits that a task holds at once.
SHORT_QUERIES, HITS = 20_000, 1 << 16


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def light(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A broadcast hint for what is joined with ``df`` and has no more rows, if it has few; else nothing."""
    return F.broadcast if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else lambda other: other


def postings(docs: DataFrame, key: str, text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(key, term, tf): counts of terms by document, pre-aggregated where the documents are; of ``terms`` (term) only, if given."""
    flat = docs.select(key, F.explode(tokens(text)).alias("term"))
    if terms is not None:
        flat = flat.join(small(terms), "term", "left_semi")
    return flat.groupBy(key, "term").agg(F.count("*").alias("tf"))


def corpus_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df), and under a null term the documents, with ``dl`` their words and ``with_text`` how many have a text."""
    w = tokens(text)
    kind = "array<struct<term:string,dl:int>>"
    terms = F.coalesce(F.transform(F.array_distinct(w), lambda x: F.struct(x.alias("term"), F.lit(None).cast("int").alias("dl"))), F.array().cast(kind))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.when(F.col(text).isNotNull(), F.size(w)).alias("dl")))
    flat = docs.select(F.explode(F.concat(terms, whole)).alias("x")).select("x.*")
    return flat.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl"), F.count("dl").alias("with_text"))


def bm25_scores(queries: DataFrame, docs: DataFrame, scope: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(item_id, doc_id, score) of documents that score above 0; idf over the whole corpus, scope applied after.

    The corpus is read twice: once for the frequency of every term, counted where the documents are, and once
    for the postings of the queries' terms, which carry their document's length; no other posting is shuffled.
    ``asked`` (item_id, term, qtf) replaces the queries' own terms.
    """
    known = corpus_terms(docs)
    # One row: document count and mean length.
    stats = known.where("term IS NULL").select(F.col("df").alias("n"), (F.col("dl") / F.col("with_text")).alias("avgdl"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = known.where("term IS NOT NULL").select("term", "df").crossJoin(F.broadcast(stats)).select("term", raw.alias("raw"), "avgdl")
    mean = idf.agg(F.avg("raw").alias("mean"))
    idf = idf.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")
    asked = postings(queries, "item_id").withColumnRenamed("tf", "qtf") if asked is None else asked
    few = asked.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS  # then what is joined with them has no more rows
    light = F.broadcast if few else lambda df: df
    # Lengths are made before the words are spread out, else every word's row would tokenise its text again.
    words = docs.select("doc_id", tokens("text").alias("w")).withColumn("dl", F.size("w")).select("doc_id", "dl", F.explode("w").alias("term"))
    post = words.join(light(asked.select("term").distinct()), "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    hits = post.join(light(asked.join(idf, "term")), "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("item_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    if scope is not None:
        wanted = queries.select("item_id", F.col(scope).alias("_want"))
        scored = scored.join(docs.select("doc_id", F.col(scope).alias("_has")), "doc_id").join(wanted, "item_id").where("_want = _has").drop("_want", "_has")
    return scored


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """(item_id, doc_id, score, rank) of each query's k best documents."""
    return ranked(bm25_scores(queries, docs, scope), "item_id", "doc_id", k)


def ranked(scored: DataFrame, query: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tfidf_weights(docs: DataFrame, key: str, terms: DataFrame | None = None) -> DataFrame:
    """(key, term, w): sublinear tf times idf, a stand-in for learned sparse weights; of ``terms`` only, if given."""
    post = postings(docs, key, terms=terms)
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return post.join(small(df) if terms is not None else df, "term").crossJoin(F.broadcast(n)).select(key, "term", ((1 + F.log("tf")) * F.log(1 + F.col("n") / F.col("df"))).alias("w"))


def sparse_topk(query_weights: DataFrame, doc_weights: DataFrame, k: int) -> DataFrame:
    """Dot products of sparse vectors (item_id, term, w) and (doc_id, term, w), above 0."""
    q = query_weights.select("item_id", "term", F.col("w").alias("wq"))
    s = q.join(doc_weights, "term").groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("wq") * F.col("w")), 6).alias("score")).where("score > 0")
    return ranked(s, "item_id", "doc_id", k)


def max_pool(tokens_: DataFrame) -> DataFrame:
    """Pooling of token logits (id, term, logit): max over tokens of log(1 + relu(logit))."""
    return tokens_.groupBy("id", "term").agg(F.round(F.max(F.log1p(F.greatest("logit", F.lit(0.0)))), 6).alias("w"))


def count_topk(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Sum of substring counts of the query's keywords, above 0.

    The keywords are the distinct ones of all queries: they are matched once, and counts join back by term.
    """
    asked = queries.select("item_id", F.explode(F.transform(keywords("text"), F.lower)).alias("term"))
    words = F.array_distinct(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}_]+"))
    # A keyword can only occur inside a document's word, so documents are indexed by their distinct words.
    vocabulary = docs.select(F.explode(words).alias("word")).distinct()
    terms = asked.select("term").distinct()
    # Words and terms meet on the terms' first three letters at every place of the word.
    grams = vocabulary.select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 2, F.lit(1))), lambda i: F.substring(F.col("word"), i, F.lit(3))))).alias("g"))
    holds = settle(grams.join(terms.withColumn("g", F.substring("term", 1, 3)), "g").where(F.expr("contains(word, term)")).select("word", "term").distinct())
    few = light(holds)
    # Words without a keyword are dropped where the documents are, before anything is counted or shuffled.
    flat = docs.select("doc_id", F.explode(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}_]+")).alias("word")).join(few(holds.select("word").distinct()), "word", "left_semi")
    each = flat.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    per = each.join(few(holds), "word").groupBy("doc_id", "term").agg(F.sum(F.col("n") * occurrences(F.col("word"), F.col("term"))).alias("n"))
    scored = asked.join(per, "term").groupBy("item_id", "doc_id").agg(F.sum("n").alias("score")).where("score > 0")
    return ranked(scored, "item_id", "doc_id", k)


def containing(queries: DataFrame, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, doc_id, keep): documents that contain a query's whole text, for texts of three words or more.

    A text's inner words stand in the document as they are, so the pairs meet on the longest of these, and only such
    pairs are searched. Few queries go to the documents, which stay where they are; many are joined by their words.
    """
    words = F.split("text", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    q = settle(queries.select("item_id", F.col("text").alias("q"), longest.alias("word")).where("word IS NOT NULL"))
    if q.limit(SMALL_QUERIES + 1).count() <= SMALL_QUERIES:
        kinds = dict(queries.dtypes) | dict(docs.dtypes)
        shared = docs.sparkSession.sparkContext.broadcast(q.toArrow())

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked: dict[bytes, list] = {}
            for item, text, word in zip(*(shared.value.column(c).to_pylist() for c in ("item_id", "q", "word")), strict=True):
                asked.setdefault(word.encode(), []).append((item, text.encode()))
            known = marks(asked)
            for b in (part for whole in batches for part in pieces(whole, "text")):
                # A word may stand in a document more than once.
                met = {(i, word): bytes(text) for i, word, text in spaced(b.column("text"), known) if word in asked}
                hits = [(i, item) for (i, word), text in met.items() for item, q in asked[word] if q in text]
                at, items = [i for i, _ in hits], [item for _, item in hits]
                yield pa.RecordBatch.from_pydict({"item_id": pa.array(items, shared.value.schema.field("item_id").type)} | {c: b.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", *keep)})

        return docs.select("doc_id", "text", *keep).mapInArrow(search, ", ".join(f"`{c}` {kinds[c]}" for c in ("item_id", "doc_id", *keep)))
    d = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    pairs = d.join(q, "word").select("doc_id", "item_id", "q")
    return pairs.join(docs.select("doc_id", "text", *keep), "doc_id").where(F.expr("contains(text, q)")).select("item_id", "doc_id", *keep)


def holding(queries: DataFrame, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, doc_id, keep): documents that contain a query's whole text, whatever its length; an empty one is in every text.

    Texts of less than three words have no inner word to meet on, so documents are searched for their beginnings.
    """
    found = containing(queries, docs, keep)
    short = settle(queries.where(F.size(F.split("text", " ")) < 3).where("text IS NOT NULL").select("item_id", F.col("text").alias("q")))
    passes = -(-short.count() // SHORT_QUERIES)
    for i in range(passes):
        mine = short.where(F.pmod(F.xxhash64("item_id", "q"), F.lit(passes)) == i)
        found = found.union(_short(mine, docs, keep))
    return found


def _short(q: DataFrame, docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    kinds = dict(q.dtypes) | dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(q.toArrow())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[bytes, list] = {}
        for item, text in zip(*(shared.value.column(c).to_pylist() for c in ("item_id", "q")), strict=True):
            asked.setdefault(text.encode()[:8], []).append((item, text.encode()))
        kind = shared.value.schema.field("item_id").type
        for b in (part for whole in batches for part in pieces(whole, "text")):
            met = ((i, asked[begin], bytes(text)) for i, begin, text in openings(b.column("text"), asked))
            hits = ((i, item) for i, mine, text in met for item, q in mine if len(q) <= 8 or q in text)
            while some := list(islice(hits, HITS)):
                at, items = zip(*some, strict=True)
                yield pa.RecordBatch.from_pydict({"item_id": pa.array(items, kind)} | {c: b.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", *keep)})

    return docs.select("doc_id", "text", *keep).mapInArrow(search, ", ".join(f"`{c}` {kinds[c]}" for c in ("item_id", "doc_id", *keep)))
