"""Table functions: chunkers that SQL can call with ``LATERAL``, one input row at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.chunking import split_recursive


@udtf(returnType="part: bigint, chunk: string")
class RecursiveChunks:
    """``recursive_chunks(text, size, overlap)``: pieces of a text at its coarsest separators."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        for i, c in enumerate(split_recursive(text or "", size, overlap)):
            yield i, c


@udtf(returnType="part: bigint, chunk: string")
class SentenceGroups:
    """``sentence_groups(text, size, least)``: so many pieces between ``". "`` at a time, from ``least`` characters on."""

    def eval(self, text: str, size: int, least: int) -> Iterator[tuple[int, str]]:
        pieces = [] if text is None else text.split(". ")
        for i in range(0, len(pieces), size):
            chunk = ". ".join(pieces[i : i + size])
            if len(chunk.strip(" ")) >= least:
                yield i // size, chunk


def register(spark: SparkSession) -> None:
    spark.udtf.register("recursive_chunks", RecursiveChunks)
    spark.udtf.register("sentence_groups", SentenceGroups)
