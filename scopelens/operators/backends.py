"""One interface for all ways of searching, and a decorator that reranks any of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import settle
from ..sources.indexes import TextIndex, VectorIndex
from . import forward, lexical
from .systems import HashEmbedder, embed

#: Fixed value: characters of a text that a pair score reads.
PAIR_CHARS = 1500


class Backend(Protocol):
    """What a system asks of a search: queries (item_id, text[, scope]) to (item_id, doc_id, score, rank) of ``limit`` rows each.

    A query with a scope sees the documents of that scope only, one without sees all.
    """

    def search(self, queries: DataFrame, limit: int) -> DataFrame: ...


def _split(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    q = queries if "scope" in queries.columns else queries.withColumn("scope", F.lit(None).cast("string"))
    return q.where("scope IS NULL"), q.where("scope IS NOT NULL")


@dataclass
class Lexical:
    """BM25 on postings; ``scope`` names the indexed column that a query's scope is about."""

    index: TextIndex
    scope: str | None = None

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        scoped = self.scope is not None and "scope" in queries.columns
        return self.index.topk(queries, limit, scope="scope" if scoped else None, has=self.scope, every=True)


@dataclass
class Sparse:
    """Dot products of sparse weights of documents (doc_id, text[, scope]), or of those of an index, with those of the queries."""

    docs: DataFrame
    index: TextIndex | None = None
    scope: str = "scope"

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        scoped = "scope" in queries.columns
        q = settle(lexical.tfidf_weights(queries, "item_id"))
        if self.index is not None:
            rows, n, df = self.index.table("docs"), self.index.stats.n, self.index.known(q)
        else:
            rows = forward.rows(self.docs, "doc_id", keep=(self.scope,) if scoped else ())
            n, own = self.docs.count(), q.select("term").distinct()
            df = rows.select(F.explode("terms").alias("term")).join(lexical.small(own), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
        asked = q.join(df, "term").select("item_id", "term", (F.col("w") * F.log(1 + n / F.col("df"))).alias("w"))
        if scoped:
            asked, rows = asked.join(queries.select("item_id", F.col("scope").alias("want")), "item_id"), rows.withColumn("has", F.col(self.scope))
        return forward.best(rows, asked, limit, "doc_id", lambda tf, dl: 1 + np.log(tf), every=True)


@dataclass
class Kept:
    """Another backend's answers to one set of queries, searched for once: shorter lists begin longer ones."""

    base: Backend
    most: int
    _found: DataFrame | None = None

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        if limit > self.most:
            return self.base.search(queries, limit)
        if self._found is None:
            self._found = settle(self.base.search(queries, self.most))
        return self._found.where(F.col("rank") <= limit)


@dataclass
class Dense:
    """Inner products of embedded texts with an index of embedded documents."""

    index: VectorIndex
    make: Callable = HashEmbedder

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        every, some = _split(embed(queries, "text", make=self.make).withColumnRenamed("item_id", "qid"))
        found = self.index.topk(every.select("qid", "v"), limit)
        if "scope" in queries.columns:
            found = found.unionByName(self.index.topk(some.select("qid", "v", "scope"), limit))
        return found.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), F.col("sim").alias("score"), "rank")


def overlap(question: Column, text: Column) -> Column:
    """A stand-in pair score: shared words over all words."""
    q, d = tokens(question), tokens(text)
    return F.size(F.array_intersect(q, d)) / F.greatest(F.size(F.array_union(q, d)), F.lit(1))


@dataclass
class Reranked:
    """Any backend's first ``candidates`` rows, ordered anew by a pair score on the question and the text's first characters."""

    base: Backend
    texts: DataFrame
    candidates: int = 30
    final: int = 10
    score: Callable[[Column, Column], Column] = overlap

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        found = settle(self.base.search(queries, self.candidates).select("item_id", "doc_id"))
        # Candidates go to the texts where they are few, else both are shuffled.
        pairs = lexical.light(found)(found).join(self.texts.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, PAIR_CHARS).alias("_d")), "doc_id").join(queries.select("item_id", F.col("text").alias("_q")), "item_id")
        scored = pairs.select("item_id", "doc_id", F.round(self.score(F.col("_q"), F.col("_d")), 6).alias("score"))
        return lexical.ranked(scored, "item_id", "doc_id", min(limit, self.final))
