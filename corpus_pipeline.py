"""From raw documents to tokens in five stages; each reads the table that the one before has written.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Stages meet in Parquet tables in the folder that all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopelens.llm import bpe, jaccard, mixing, substrings, toxicity
from scopelens.llm.common import shared_folder
from scopelens.llm.registry import ranks_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can express neither the classifier nor the merges; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of a model fitted on the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < toxicity.THRESHOLD).drop("score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    return jaccard.keep_one(docs.select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur elsewhere too."""
    kept = substrings.remove_repeated(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs.select(*COLUMNS))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) in place of texts."""
    return bpe.encode(docs.select(*COLUMNS), ranks_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", to_tokens),
]


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``; a stage's table goes when the next one is written."""
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{root}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            _remove(spark, f"{root}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
