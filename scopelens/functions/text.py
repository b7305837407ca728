"""Column expressions on text: tokens, normal forms, ids, taxonomies. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import STEM_NOISE, STEM_WORDS, STOPWORDS

TOKEN = "[a-z0-9_]+"


def tokens(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def keywords(text: str | Column, most: int = 8) -> Column:
    """The first words of more than 2 letters that are no stopwords, punctuation stripped; case stays."""
    c = F.col(text) if isinstance(text, str) else text
    words = F.split(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " ")), r"\s+")
    keep = F.filter(words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*STOPWORDS))
    return F.slice(keep, 1, most)


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` occurs in ``text`` without overlap."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("bigint")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def compose_label(*parts: Column, sep: str = "::") -> Column:
    """Fields trimmed, squeezed, upper-cased and joined."""
    return F.concat_ws(sep, *[F.upper(squeeze(F.coalesce(p, F.lit("")))) for p in parts])


def safe_join(*parts: Column) -> Column:
    """Non-empty stripped parts with one space between."""
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def first_match(value: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first (pattern, label) whose pattern is found, ignoring case."""
    return F.coalesce(*[F.when(value.rlike(f"(?i){p}"), F.lit(label)) for p, label in rules], F.lit(default))


def title_bucket(title: Column) -> Column:
    c = F.upper(F.substring(F.trim(title), 1, 1))
    return (
        F.when(c.between("A", "G"), "A-G").when(c.between("H", "M"), "H-M").when(c.between("N", "S"), "N-S").when(c.between("T", "Z"), "T-Z").otherwise("other")
    )


def title_stem(title: Column, also: tuple[str, ...] = ()) -> Column:
    """Letters of a title without years, revision marks, parentheses and joining words (and those of ``also``)."""
    bare = F.regexp_replace(F.lower(title), STEM_NOISE, " ")
    return F.array_join(F.filter(F.split(F.trim(bare), " +"), lambda w: ~w.isin(*STEM_WORDS, *also)), " ")


def composite_id(*parts: Column, index: Column) -> Column:
    """Parts and a three-digit index joined by ``::``."""
    return F.concat_ws("::", *parts, F.lpad(index.cast("string"), 3, "0"))


def sentences(text: Column) -> Column:
    """Pieces that end with a full stop, question or exclamation mark followed by space."""
    return F.split(text, r"(?<=[.!?])\s+")


def pack_sentences(text: Column, most: int = 800) -> Column:
    """Greedy packing: a sentence that would make the chunk longer than ``most`` begins a new one."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("chunks"), F.lit("").alias("cur"))

    def add(s: Column, x: Column) -> Column:
        flush = (F.length(s["cur"]) + F.length(x) > most) & (s["cur"] != "")
        joined = F.when(s["cur"] == "", x).otherwise(F.concat(s["cur"], F.lit(" "), x))
        return F.struct(F.when(flush, F.concat(s["chunks"], F.array(s["cur"]))).otherwise(s["chunks"]).alias("chunks"), F.when(flush, x).otherwise(joined).alias("cur"))

    def close(s: Column) -> Column:
        return F.when(s["cur"] != "", F.concat(s["chunks"], F.array(s["cur"]))).otherwise(s["chunks"])

    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.aggregate(sentences(text), start, add, close))


def answer_form(text: Column) -> Column:
    """Lower case, ASCII punctuation dropped, articles dropped, spaces squeezed; the order matters."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(F.split(bare, r"\s+"), lambda w: (w != "") & ~w.isin("a", "an", "the")), " ")
