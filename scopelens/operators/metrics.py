"""Retrieval and answer metrics over ranked rows and text pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_form


def at_k(ranked: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(query, p, hit, mrr, ndcg) from rows with rank and rel (0/1). The ideal order is that of the retrieved relevant rows."""
    r = ranked.where(F.col("rank") <= k)
    gain = F.col("rel") / F.log2(F.col("rank") + 1.0)
    per = r.groupBy(query).agg(F.sum("rel").alias("n"), F.sum(gain).alias("dcg"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return per.select(
        query,
        F.round(F.col("n") / float(k), 6).alias("p"),
        (F.col("n") > 0).cast("int").alias("hit"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def graded_at_k(ranked: DataFrame, qrels: DataFrame, query: str, doc: str, k: int = 10) -> DataFrame:
    """(query, ndcg, mrr, recall) with gains 2^grade - 1 and the ideal order of all qrels."""
    from pyspark.sql import Window

    w = Window.partitionBy(query).orderBy(F.desc("grade"), doc)
    best = qrels.withColumn("i", F.row_number().over(w))
    gain = lambda place: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(place) + 1.0)
    ideal = best.groupBy(query).agg(F.sum(F.when(F.col("i") <= k, gain("i"))).alias("idcg"), F.sum((F.col("grade") > 0).cast("int")).alias("relevant"))
    got = ranked.where(F.col("rank") <= k).join(qrels, [query, doc]).where("grade > 0")
    per = got.groupBy(query).agg(F.sum(gain("rank")).alias("dcg"), F.min("rank").alias("first"), F.count("*").alias("n"))
    return ideal.join(per, query, "left").select(
        query,
        F.round(F.coalesce(F.col("dcg") / F.nullif("idcg", F.lit(0.0)), F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("n") / F.nullif("relevant", F.lit(0)), F.lit(0.0)), 6).alias("recall"),
    )


def exact_match(prediction: Column, gold: Column) -> Column:
    return (answer_form(prediction) == answer_form(gold)).cast("int")


def contains_answer(prediction: Column, gold: Column) -> Column:
    return F.when(answer_form(gold) == "", 0).otherwise(F.contains(answer_form(prediction), answer_form(gold)).cast("int"))


def window_match(prediction: Column, gold: Column) -> Column:
    """Whether the gold words stand together in the prediction; gold answers of over 20 words as a plain substring."""
    p, g = answer_form(prediction), answer_form(gold)
    padded = F.contains(F.concat(F.lit(" "), p, F.lit(" ")), F.concat(F.lit(" "), g, F.lit(" ")))
    return F.when(g == "", 0).otherwise(F.when(F.size(F.split(g, " ")) > 20, F.contains(p, g)).otherwise(padded).cast("int"))


def token_f1(pairs: DataFrame, key: list[str], prediction: str, gold: str) -> DataFrame:
    """(key, f1): overlap of the two word multisets."""
    words = lambda c: F.filter(F.split(answer_form(F.col(c)), " "), lambda w: w != "")
    p = pairs.select(*key, words(prediction).alias("p"), words(gold).alias("g"))
    n = p.select(*key, F.size("p").alias("np"), F.size("g").alias("ng"))
    count = lambda c: p.select(*key, F.explode(c).alias("w")).groupBy(*key, "w").agg(F.count("*").alias(f"n_{c}"))
    common = count("p").join(count("g"), [*key, "w"]).groupBy(*key).agg(F.sum(F.least("n_p", "n_g")).alias("c"))
    c = F.coalesce("c", F.lit(0)).cast("double")
    prec, rec = c / F.col("np"), c / F.col("ng")
    f1 = F.when((F.col("np") == 0) | (F.col("ng") == 0), (F.col("np") == F.col("ng")).cast("double")).when(c == 0, 0.0).otherwise(2 * prec * rec / (prec + rec))
    return n.join(common, key, "left").select(*key, F.round(f1, 6).alias("f1"))


def ladder_hit(ids: Column, titles: Column, gold_id: Column, gold_title: Column, k: Column) -> Column:
    """Whether the first k hold the gold id, or, for rows without one, the gold title in normal form; null without either."""
    plain = lambda c: F.lower(F.trim(c))
    return F.when(gold_id.isNotNull(), F.coalesce(F.array_contains(F.slice(ids, F.lit(1), k), gold_id), F.lit(False)).cast("int")).when(
        gold_title.isNotNull(), F.coalesce(F.exists(F.slice(titles, F.lit(1), k), lambda x: plain(F.coalesce(x, F.lit(""))) == plain(gold_title)), F.lit(False)).cast("int")
    )
