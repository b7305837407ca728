"""License scans: exact phrases, and an exact containment join of text blocks with licence templates.

The join: a text's words fall into blocks of ``block`` words, a new one every ``block // 2``, so a run of
up to half a block lies whole in one. A block meets template T when it holds at least ``threshold`` of T's
distinct words; a template of more than half a block is cut into pieces of that length, and any of them will do.
Template words are ordered by their frequency over all documents, rarest first. T's first
|T| - ceil(threshold |T|) + 1 words (its prefix) are posted, and a block's template words meet the postings in an
equi-join, so cost follows the hits and not blocks times templates. A hit stays where the block has enough template words
(length filter), where enough of the block's follow from it on (positional filter), and where it is the first one shared
with T's prefix; only then is the block verified.

One pass over the corpus reads phrases, word counts and each text's template words. The same join on whole texts
then tells which texts can hold such a block at all; only those are cut into blocks in the second pass, which doesn't
shuffle texts. They are named by 128 bits of hash; where they are too many to broadcast, the second pass takes all texts.

Only DataFrame functions are used. Defined cases: a null text counts as empty; texts shorter than a block
are one block; repeated rows each give a row; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything below 0x80 that is no digit and no letter; what lies above belongs to words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Sentences by which common licences are granted.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}
BLOCK, THRESHOLD = 64, 0.9
#: Names of texts (two hashes each) that are broadcast at most.
BROADCAST_NAMES = 200_000


def normal_text(text: Column) -> Column:
    """The text's words in lower case (A-Z only), joined by one space."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, " "))


def template_words() -> dict[str, list[str]]:
    return {k: sorted(set(v.split())) for k, v in TEMPLATES.items()}


def pieces(templates: dict[str, str], block: int) -> list[tuple[str, set[str]]]:
    """(label, distinct words) of every template, the long ones in pieces; the last piece reaches back to full length."""
    half, out = block // 2, []
    for label, text in templates.items():
        words = text.split()
        starts = [min(i, max(0, len(words) - half)) for i in range(0, max(1, len(words)), half)]
        out += [(label, set(words[i : i + half])) for i in starts if words]
    return out


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


class Postings:
    """The templates' prefixes under one global order of words. All of it is bounded by the templates."""

    def __init__(self, templates: list[tuple[str, set[str]]], frequency: dict[str, int], threshold: float):
        self.order = sorted({w for _, ws in templates for w in ws}, key=lambda w: (frequency.get(w, 0), w))
        place = {w: i for i, w in enumerate(self.order)}
        self.rows, self.least = [], None
        for no, (label, ws) in enumerate(templates):
            own = sorted(ws, key=place.__getitem__)
            need = math.ceil(threshold * len(own))
            prefix = own[: len(own) - need + 1]
            self.least = need if self.least is None else min(self.least, need)
            self.rows += [(w, no, label, need, prefix, own) for w in prefix]
        self.prefixes = sorted({r[0] for r in self.rows}, key=place.__getitem__)

    def table(self, df: DataFrame) -> DataFrame:
        rows = [
            F.struct(F.lit(w).alias("word"), F.lit(no).alias("no"), F.lit(label).alias("label"), F.lit(need).alias("need"), _array(prefix).alias("prefix"), _array(own).alias("own"))
            for w, no, label, need, prefix, own in self.rows
        ]
        return df.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")

    def meet(self, df: DataFrame, words: str) -> DataFrame:
        """Rows of ``df`` with every template piece that ``words`` meets: its ``label`` and the ``containment``."""
        keep = [c for c in df.columns if c != words]
        has = df.where(F.arrays_overlap(words, _array(self.prefixes))).select(*keep, F.array_intersect(_array(self.order), words).alias("_held"))
        hits = has.where(F.size("_held") >= self.least).select(*keep, "_held", F.posexplode("_held").alias("_at", "word"))
        near = hits.join(self.table(df), "word").where((F.size("_held") - F.col("_at") >= F.col("need")) & (F.get(F.array_intersect("prefix", "_held"), F.lit(0)) == F.col("word")))
        shared = F.size(F.array_intersect("own", "_held"))
        return near.where(shared >= F.col("need")).select(*keep, "label", (shared / F.size("own")).alias("containment"))


def scan_licenses(docs: DataFrame, block: int = BLOCK, threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``docs`` (doc_id, text) to one row each: words, phrase places, labels of both kinds, and the best score.

    ``matches`` holds (label, containment) of the best block of every template that some block meets.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    name = [F.xxhash64(text).alias("ha"), F.xxhash64(F.lit(0x5EED), text, F.octet_length(text)).alias("hb")]
    parts = pieces(templates, block)
    known = sorted({w for _, ws in parts for w in ws})
    norm = docs.select("doc_id", *name, normal_text(F.col("text")).alias("norm"))
    padded = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    n_spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    count, first, last, label = [], [], [], []
    for kind, phrase in PHRASES.items():
        there = padded.contains(f" {phrase} ")
        # The next place may begin with the space that ends this one, hence the lookahead.
        count.append(F.when(there, F.regexp_count(padded, F.lit(f" {phrase}(?= )"))).otherwise(0))
        first.append(F.when(there, n_spaces(F.substring_index(padded, f" {phrase} ", 1))))
        tail = F.substring_index(padded, f" {phrase} ", -1)
        last.append(F.when(there, n_spaces(padded) - n_spaces(tail) - len(phrase.split()) - 1))
        label.append(F.when(there, F.lit(kind)))
    base = cut(
        norm.select(
            "doc_id", "ha", "hb",
            F.when(F.col("norm") == "", 0).otherwise(n_spaces(F.col("norm")) + 1).cast("bigint").alias("n_words"),
            sum(count[1:], count[0]).cast("bigint").alias("n_base"),
            F.least(*first).cast("bigint").alias("first_word"),
            F.greatest(*last).cast("bigint").alias("last_word"),
            F.array_compact(F.array(*label)).alias("base"),
            F.array_intersect(F.split("norm", " "), _array(known) if known else F.array().cast("array<string>")).alias("held"),
        )
    )
    found = _found(docs.select(*name, "text"), base, parts, block, threshold) if parts else None
    nothing = F.array().cast("array<struct<label:string,containment:double>>")
    out = base.withColumn("matches", nothing) if found is None else base.join(found, ["ha", "hb"], "left").withColumn("matches", F.coalesce("matches", nothing))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.col("matches.label"))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"),
        "matches",
    )


def _found(texts: DataFrame, base: DataFrame, parts: list[tuple[str, set[str]]], block: int, threshold: float) -> DataFrame:
    """(ha, hb, matches) of the texts of which some block meets a template."""
    frequency = {r.w: r.n for r in base.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row per template word
    post = Postings(parts, frequency, threshold)
    maybe = cut(post.meet(base.select("ha", "hb", "held"), "held").select("ha", "hb").distinct())
    few = maybe.count() <= BROADCAST_NAMES
    todo = texts.join(F.broadcast(maybe), ["ha", "hb"], "left_semi") if few else texts
    words = todo.select("ha", "hb", F.split(normal_text(F.col("text")), " ").alias("words"))
    half = block // 2
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - half - 1, F.lit(0)), F.lit(half))
    blocks = words.select("ha", "hb", F.explode(F.transform(starts, lambda s: F.slice("words", s + 1, F.lit(block)))).alias("words"))
    best = post.meet(blocks, "words").groupBy("ha", "hb", "label").agg(F.max("containment").alias("containment"))
    found = best.groupBy("ha", "hb").agg(F.array_sort(F.collect_list(F.struct("label", "containment"))).alias("matches"))  # at most one per label
    return F.broadcast(found) if few else found
