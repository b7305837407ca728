"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import TOPICS
from ..functions.text import first_match
from ..sources.indexes import TextIndex, VectorIndex, source_version, text_index, vector_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables by name: ``t.documents`` and so on, read as Parquet with column pruning."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What several parts of a query use, made when the first one asks for it."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def text_index(self) -> TextIndex:
        """Postings of ``documents``, built when first asked for."""
        cores = self.spark.sparkContext.defaultParallelism
        # A document's topic needs its text, so it is kept with the words: no scoped search has to join documents for it.
        docs = self.documents.withColumn("topic", first_match(F.col("text"), TOPICS, "general"))
        return text_index(docs, "doc_id", "text", ("source", "lang", "topic"), lambda d: d.repartition(cores) if d.rdd.getNumPartitions() < cores else d)

    def vector_index(self) -> VectorIndex:
        """The embeddings by label and centroid, built when first asked for."""
        rows = self.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("scope"))
        return vector_index(rows, source_version(self.embeddings.select("vec_id", "embedding", "label")))

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy per row: one that is stored in fewer splits than there are cores is dealt out."""
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def query(oracle: str | None = None, name: str | None = None):
    """Registers ``f(t: Tables) -> DataFrame`` under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[key] = oracle
        return f

    return add
