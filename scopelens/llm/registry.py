"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, hnsw, jaccard, licenses, mixing, periodic, sharding, spelling, substrings, syncmers, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeated(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


@_query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents"))


PROBE = "</s>[INST] ok [/INST]"


@_query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    back = chat.read_back(chat.format_conversations(chat.as_messages(turns.union(probe))))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLES["op3_chat_formatting"] = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
t AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)({chat.CONTROL})', '\1\\\2\3', 'g') AS body,
         replace(replace(role, '\', '\\'), chr(10), '\n') AS head
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(chat.OPEN) + 1 + len(chat.CLOSE)} + length(head) + length(body)) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def ranks_path() -> str:
    """The vocabulary that op4 is to use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@_query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, ranks_path()), ranks_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_read(spark, sf_dir, "embeddings"), least=0.9)


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_read(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@_query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@_query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_read(spark, sf_dir, "documents"))


@_query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_loops(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = found.withColumn("best", periodic.longest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query
def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syncmers.compare_edited(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.as_text(F.col("fingerprint")).alias("fingerprint"),
        syncmers.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


SLIP = 199


@_query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(_read(spark, sf_dir, "documents").select("doc_id", "text"), slip=SLIP)
    return spelling.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


ORACLES["op13_spelling_variants"] = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '{spelling.RUN}')) AS run FROM documents),
per AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY id, run),
-- A checksum bit by bit: every byte is followed by seven zeros, one for each further shift.
bits AS (SELECT run, k, list_reduce(flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c), 0, 0, 0, 0, 0, 0, 0] ELSE [192 | (unicode(c) >> 6), 0, 0, 0, 0, 0, 0, 0, 128 | (unicode(c) & 63), 0, 0, 0, 0, 0, 0, 0] END))::BIGINT[],
    lambda x, y: CASE WHEN xor(x, y) & 1 = 1 THEN xor(xor(x, y) >> 1, 3988292384) ELSE xor(x, y) >> 1 END, 4294967295) AS c FROM per),
h AS (SELECT run, k, xor(c, 4294967295) AS h FROM bits),
f AS (SELECT k, CASE WHEN h % {SLIP} = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM f WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {spelling.LEAST_COUNT}),
gaps AS (SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS (
  SELECT g.word AS a, w.word AS b FROM gaps g JOIN w ON g.rest = w.word
  UNION SELECT w.word, g.word FROM gaps g JOIN w ON g.rest = w.word
  UNION SELECT x.word, y.word FROM gaps x JOIN gaps y ON x.i = y.i AND x.rest = y.rest WHERE x.word <> y.word),
best AS (SELECT a, count(*) OVER (PARTITION BY a) AS n_near, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM near JOIN w ON w.word = near.b),
found AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= {spelling.TIMES} * w.n THEN b END AS form, CASE WHEN best.n >= {spelling.TIMES} * w.n THEN best.n END AS form_n
  FROM w LEFT JOIN best ON best.a = w.word AND r = 1),
up AS (SELECT word, word AS root FROM found UNION ALL SELECT up.word, found.form FROM up JOIN found ON up.root = found.word WHERE found.form IS NOT NULL)
SELECT found.word, found.form, up.root, found.n, found.n_near, found.form_n FROM found JOIN up ON up.word = found.word JOIN found AS last ON last.word = up.root AND last.form IS NULL
"""


def _license_sql() -> str:
    def double(s: str) -> str:
        return s.replace(" ", "  ")

    phrases, labels, parts = [], [], []
    for i, (name, phrase) in enumerate(licenses.PHRASES.items()):
        wide = f" {double(phrase)} "
        phrases += [
            f"CAST((length(wide) - length(replace(wide, '{wide}', ''))) / {len(wide)} AS BIGINT) AS n{i}",
            f"CASE WHEN contains(wide, '{wide}') THEN len(regexp_extract_all(string_split(wide, '{wide}')[1], '[^ ]+')) END AS f{i}",
            f"CASE WHEN contains(wide, '{wide}') THEN n_words - {len(phrase.split())} - len(regexp_extract_all(string_split(wide, '{wide}')[-1], '[^ ]+')) END AS l{i}",
        ]
        labels.append(f"CASE WHEN n{i} > 0 THEN '{name}' END")
    import math

    for i, (_label, words) in enumerate(licenses.template_words().items()):
        need = math.ceil(licenses.THRESHOLD * len(words))
        array = "[" + ", ".join(f"'{w}'" for w in words) + "]"
        half = licenses.BLOCK // 2
        best = f"list_max(list_transform(generate_series(0, greatest(len(words) - {half} - 1, 0), {half}), lambda s: len(list_intersect({array}, words[s + 1 : s + {licenses.BLOCK}]))))"
        parts.append(f"CASE WHEN {best} >= {need} THEN {best} / {len(words)}::DOUBLE END AS m{i}")
    kinds = list(licenses.TEMPLATES)
    found = ", ".join(f"CASE WHEN m{i} IS NOT NULL THEN '{k}' END" for i, k in enumerate(kinds))
    ms, n = ", ".join(f"m{i}" for i in range(len(kinds))), len(licenses.PHRASES)
    tidy = "array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ',')"
    return rf"""
WITH a AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.NOT_WORD}', ' ', 'g')) AS norm FROM documents),
b AS (SELECT doc_id, string_split(norm, ' ') AS words, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS n_words, replace(' ' || norm || ' ', ' ', '  ') AS wide FROM a),
c AS (SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, {", ".join(phrases)}, {", ".join(parts)} FROM b)
SELECT doc_id, n_words, CAST({" + ".join(f"n{i}" for i in range(n))} AS BIGINT) AS n_base,
       CAST(least({", ".join(f"f{i}" for i in range(n))}) AS BIGINT) AS first_word,
       CAST(greatest({", ".join(f"l{i}" for i in range(n))}) AS BIGINT) AS last_word,
       {tidy.format(", ".join(labels))} AS base_labels,
       {tidy.format(", ".join(labels) + ", " + found)} AS labels,
       CASE WHEN {" + ".join(f"n{i}" for i in range(n))} > 0 THEN 1.0::DOUBLE ELSE coalesce(greatest({ms}), 0.0::DOUBLE) END AS score
FROM c
"""


ORACLES["op8_license_scan"] = _license_sql()
