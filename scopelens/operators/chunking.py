"""Text segmentation: sentence groups, recursive character splitting, sections and pages carried forward."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sentence_groups(docs: DataFrame, key: str, text: str, size: int = 3, least: int = 50) -> DataFrame:
    """(key, part, chunk): every ``size`` pieces between ``". "``, kept from ``least`` characters on."""
    pieces = F.split(F.col(text), r"\. ")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / size).cast("int")), lambda i: F.array_join(F.slice(pieces, i * size + 1, F.lit(size)), ". "))
    return docs.select(key, F.posexplode(groups).alias("part", "chunk")).where(F.length(F.trim("chunk")) >= least)


SEPARATORS = ("\n\n", "\n", " ", "")


def split_recursive(text: str, size: int = 1000, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Splits at the first separator that occurs, packs pieces up to ``size`` with ``overlap`` carried over, and
    splits pieces that are still too long at the next separators."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    pieces = list(text) if sep == "" else [p for p in text.split(sep) if p]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        chunk = sep.join(held).strip()
        if chunk:
            out.append(chunk)

    for p in pieces:
        if len(p) > size and rest:
            flush()
            held, length = [], 0
            out += split_recursive(p, size, overlap, rest)
            continue
        if held and length + len(p) + len(sep) > size:
            flush()
            while held and (length > overlap or length + len(p) + len(sep) > size):
                length -= len(held.pop(0)) + (len(sep) if held else 0)
        length += len(p) + (len(sep) if held else 0)
        held.append(p)
    flush()
    return out


def recursive_chunks(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """(key, part, chunk) by ``split_recursive``, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b[key], b[text], strict=True) for i, c in enumerate(split_recursive(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "part", "chunk"])

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, part int, chunk string")


def rechunk(df: DataFrame, source: str, order: str, text: str, size: int = 1000, overlap: int = 100, least: int = 40) -> DataFrame:
    """(source, part, chunk): a source's rows, joined by line breaks in their order, split anew; short chunks are left out.

    A row counts once however often it is repeated. A source is one file, so its text is one row of the result.
    """
    rows = df.where(F.col(text).isNotNull()).select(source, order, text).distinct()
    whole = rows.groupBy(source).agg(F.array_join(F.array_sort(F.collect_list(F.struct(order, text)))[text], "\n").alias("_whole"))
    return recursive_chunks(whole, source, "_whole", size, overlap).where(F.length(F.trim("chunk")) >= least)


def carry_forward(df: DataFrame, doc: str, order: str, heading: Column, default: str = "General") -> Column:
    """The last heading at or before a row of its document."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit(default))


def page_of(offset: Column, spans: Column) -> Column:
    """The page of the first span (start, end, page) that holds the offset, ends included; else the last page."""
    hit = F.filter(spans, lambda s: (s["start"] <= offset) & (offset <= s["end"]))
    return F.when(F.size(hit) > 0, F.element_at(hit, 1)["page"]).otherwise(F.element_at(spans, -1)["page"])
