"""File sources and sinks: tolerant JSON lines, CSV, sparse rows, resumable appends, upserts, report tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

RUN_SCHEMA = "query_id string, system string, answer string, n_chunks int, chunk_ids array<string>, wall_time_s double, error string"
QUERY_SCHEMA = "query_id string, query string, reference_answer string, category string, gold_titles array<string>"


def read_jsonl(spark: SparkSession, path: str, schema: str = RUN_SCHEMA, drop_errors: bool = True) -> DataFrame:
    """JSON lines (also gzipped) without malformed lines, and without rows that carry an error."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.where(F.col("error").isNull()) if drop_errors and "error" in df.columns else df


def read_suite(spark: SparkSession, path: str, schema: str = QUERY_SCHEMA) -> DataFrame:
    """A JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """One of several sources; a missing one is empty."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append_new(df: DataFrame, path: str, keys: list[str], retry_errors: bool = True) -> None:
    """Appends rows whose key the sink doesn't have yet; a row with an error doesn't count as done if retried."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    done = read_or_empty(df.sparkSession, path, kinds)
    if retry_errors and "error" in done.columns:
        done = done.where(F.col("error").isNull())
    df.join(done.select(*keys).distinct(), keys, "left_anti").write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header and doubled quotes; null and the empty text are both an empty field, as CSV has no null."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; fields may hold line breaks and doubled quotes, empty ones are null."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("enforceSchema", False).csv(path)


def insert_batches(df: DataFrame, insert: Callable[[list[dict]], None], size: int = 500) -> None:
    """Hands every row to ``insert`` in lists of at most ``size``, from the tasks; a task that is run again inserts again."""

    def send(rows: Iterator) -> None:
        while batch := [r.asDict(recursive=True) for r in itertools.islice(rows, size)]:
            insert(batch)

    df.foreachPartition(send)


def reset(spark: SparkSession, path: str, keep: Column | None = None) -> None:
    """Deletes a Parquet table's rows but those that ``keep`` holds for; may be repeated, and a missing table stays missing.

    What stays is written beside the table first, then swapped in, so that a failure leaves the old rows.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    here, beside = hadoop(path), hadoop(f"{path}.reset")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(here):
        return
    old = spark.read.parquet(path)
    old.where(F.lit(False) if keep is None else F.coalesce(keep, F.lit(False))).write.mode("overwrite").parquet(f"{path}.reset")
    fs.delete(here, True)
    fs.rename(beside, here)


def multihop_suite(raw: DataFrame) -> DataFrame:
    """MultiHop records (query, answer, question_type, evidence_list) as a query suite with distinct gold titles."""
    titles = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col("evidence_list.title"), F.array().cast("array<string>")), lambda x: x.isNotNull())))
    return raw.select("query", F.col("answer").alias("reference_answer"), F.coalesce("question_type", F.lit("general")).alias("category"), titles.alias("gold_titles"))


def hotpot_suite(raw: DataFrame) -> DataFrame:
    """Distractor records (question, answer, type, level, context, supporting_facts) with paragraphs and distinct gold titles."""
    pages = F.transform(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences")), lambda z: F.struct(z["title"].alias("title"), F.array_join(z["sentences"], " ").alias("page_content")))
    return raw.select(
        F.coalesce("question", F.lit("")).alias("query"), F.coalesce("answer", F.lit("")).alias("reference_answer"), F.coalesce("type", F.lit("general")).alias("category"),
        F.col("level").alias("question_type"), F.coalesce(pages, F.array()).alias("search_results"),
        F.array_sort(F.array_distinct(F.coalesce("supporting_facts.title", F.array().cast("array<string>")))).alias("gold_titles"),
    )


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``current`` whose key it lacks."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def cap_corpus(docs: DataFrame, qrels: DataFrame, key: str, most: int) -> DataFrame:
    """All judged documents, filled up to ``most`` with others in the order of the key."""
    judged = docs.join(qrels.select(key).distinct(), key, "left_semi")
    rest = docs.join(qrels.select(key).distinct(), key, "left_anti")
    return judged.unionByName(rest.orderBy(key).limit(max(0, most - judged.count())))


def to_sparse(df: DataFrame, key: str, values: str) -> DataFrame:
    """A dense vector column as one row of (indices, data) per key, zeros left out."""
    pairs = F.filter(F.transform(values, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    return df.select(key, pairs.alias("p")).select(key, F.col("p.i").alias("indices"), F.col("p.x").alias("data"))


def sparse_long(df: DataFrame, key: str) -> DataFrame:
    """(key, term, w) of a sparse table."""
    return df.select(key, F.explode(F.arrays_zip("indices", "data")).alias("z")).select(key, F.col("z.indices").alias("term"), F.col("z.data").alias("w"))


def page_texts(spark: SparkSession, path: str, types: dict[str, bytes] | None = None, most: int = 50 << 20) -> DataFrame:
    """Stored downloads (path, sha256, bytes, content) up to a size, one per content, that begin as their type should."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most)
    for suffix, magic in (types or {}).items():
        files = files.where(~F.lower("path").endswith(suffix) | (F.substring("content", 1, len(magic)) == F.lit(magic)))
    keyed = files.withColumn("sha256", F.sha2("content", 256))
    first = keyed.groupBy("sha256").agg(F.min("path").alias("path"))
    return keyed.join(first, ["sha256", "path"], "left_semi").select("path", "sha256", F.col("length").alias("bytes"), "content")


def markdown(df: DataFrame) -> str:
    """A summary table as Markdown: a report is read whole, so only small results belong here."""
    rows = [df.columns, ["---"] * len(df.columns), *[[_cell(x) for x in r] for r in df.toLocalIterator()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def latex(df: DataFrame) -> str:
    """The same as LaTeX rows; missing values read ``---``."""
    return "\n".join(" & ".join(_cell(x).replace("_", "\\_").replace("%", "\\%") for x in r) + r" \\" for r in df.toLocalIterator())


def _cell(x) -> str:
    return "---" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


def write_subsets(rows: DataFrame, keep: DataFrame, key: str, path: str) -> None:
    """Rows of every keep-set (size, seed, key) as one folder per size and seed."""
    rows.join(keep, key).write.mode("overwrite").partitionBy("size", "seed").parquet(path)
