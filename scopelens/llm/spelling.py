"""Spelling variant grouping: words one edit apart, found by merging subtrees of their trie with one error.

The frequent words form a trie whose nodes are their prefixes. A node's child with the most words below it is
heavy, the others are light, so a word leaves at most log2(words) nodes by a light child. At each of these
nodes, and at the node where it ends, the word's rest is merged into the node's other subtrees with the next
character skipped, replaced by the heavy child's, or preceded by it; the light subtrees are merged with each
other with that character left open. Only the smaller side ever moves, and words whose ends coincide are one
edit apart: every such pair meets at its longest common prefix, and nowhere else. A skip counts only in front
of a different character, since skipping an earlier one of equal characters gives the same word.

Nodes travel as 64-bit hashes of prefixes, from which children are counted where the words are first. A
collision of two hashes can only name another child as heavy, which costs time and no pair. Ends are compared as
strings, by a join with the words. Nodes with many words below, of which there are few, are broadcast; no other
key has more rows than the largest of these bounds or the alphabet.

Defined cases: null and empty texts have no words; a null id counts as an empty one in the checksum; repeated
rows count each; a text may be one word, and words may be long, since every step is linear in them; of equally
frequent near words the smallest in code-point order is the form; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _MULT, U64, _powers, _sums, cut, mix, steps, tune

#: Words as the query defines them, and their least length and count.
RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form must be so many times as frequent as the word.
TIMES = 5
#: Nodes that are broadcast: at most so many, those with the most words below.
BROADCAST_NODES, LEAST_SIZE = 20_000, 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(c: Column) -> Column:
    """A-Z lower-cased and nothing else; most words need no translation."""
    return F.when(F.lower(c) == c, c).otherwise(F.translate(c, UPPER, LOWER))


def word_counts(docs: DataFrame, slip: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the frequent words of all texts; counts are summed where the texts are first.

    With ``slip``, a run loses one character where ``slip`` divides the checksum of its document's id and itself.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    words = runs.select("id", _lowered(F.col("run")).alias("word"))
    if slip is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "word"))
        at = (h % F.length("word")).cast("int")
        dropped = F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        words = words.select(F.when(h % slip == 0, dropped).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, depth, node, step): the nodes of each word's path and the character after each, -1 at its end."""
    for b in steps(batches, "word"):
        words = b.column("word").to_pylist()
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        length = np.array([len(w) for w in words], np.int64)
        begin = np.r_[0, np.cumsum(length)][:-1]
        row = np.repeat(np.arange(len(words)), length + 1)
        depth = np.arange(len(row)) - np.repeat(begin + np.arange(len(words)), length + 1)
        at = begin[row] + depth
        sums = _sums(mix(codes.astype(U64) + U64(1)), _MULT)
        node = mix((sums[at] - sums[begin[row]]) * _powers(_MULT)[1].at(begin[row]) + depth.astype(U64))
        step = np.where(depth < length[row], np.r_[codes, -1][at], -1)
        names = b.column("name").to_numpy()
        yield pa.RecordBatch.from_pydict({"name": pa.array(names[row]), "depth": pa.array(depth.astype(np.int32)), "node": pa.array(node.view(np.int64)), "step": pa.array(step.astype(np.int32))})


def _light(words: DataFrame) -> DataFrame:
    """(name, depth, step, heavy): the nodes that each word leaves by a light child or by its end."""
    paths = words.select("name", "word").mapInArrow(_paths, "name bigint, depth int, node bigint, step int")
    children = paths.groupBy("node", "step").agg(F.count("*").alias("below"))
    real = F.when(F.col("step") >= 0, F.struct("below", F.col("step").alias("heavy")))
    nodes = children.groupBy("node").agg(F.max(real)["heavy"].alias("heavy"), F.sum("below").alias("size"), F.count("*").alias("children"))
    nodes = cut(nodes.where("children > 1").select("node", "heavy", "size"))
    total = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    # All sizes together are at most the words' characters and ends, so few nodes have at least this share of them.
    large = F.col("size") >= max(LEAST_SIZE, total // BROADCAST_NODES)
    top = F.broadcast(nodes.where(large).select("node", "heavy"))
    known = paths.join(top, "node", "left")
    rest = known.where("heavy IS NULL").drop("heavy").join(nodes.where(~large).select("node", "heavy"), "node")
    return known.where("heavy IS NOT NULL").unionByName(rest).where("step <> heavy").select("name", "depth", "step", "heavy")


def _merges(words: DataFrame) -> DataFrame:
    """(name, n, word, kind, depth, target): what each word would end as in its nodes' other subtrees."""
    rows = cut(_light(words)).join(words, "name")
    d = F.col("depth")
    before, after = F.substring(F.col("word"), F.lit(1), d), F.substring(F.col("word"), d + 2, F.length("word"))
    own, heavy = F.substring(F.col("word"), d + 1, F.lit(1)), F.chr("heavy")
    heavy = F.when(F.col("heavy") < 256, heavy).otherwise(F.decode(F.unhex(F.lpad(F.hex("heavy"), 8, "0")), "UTF-32"))
    inside = F.col("step") >= 0

    def merge(kind: str, target: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), target.alias("target")))

    skipped = F.concat(before, after)
    kinds = F.array(
        merge("skip", skipped, inside & (F.substring(after, 1, 1) != own)),
        merge("replace", F.concat(before, heavy, after), inside),
        merge("insert", F.concat(before, heavy, own, after), F.lit(True)),
        merge("open", skipped, inside),
    )
    return rows.select("name", "n", "word", "depth", F.explode(kinds).alias("x")).where("x IS NOT NULL").select("name", "n", "word", "depth", "x.*")


def near_words(words: DataFrame) -> DataFrame:
    """(name, n_near, best): for each word with near ones, their number and the most frequent one as (minus, word).

    ``words`` (name, word, n) holds distinct words under distinct names and is read several times.
    """
    merges = cut(_merges(words))
    ends = words.select(F.col("name").alias("other"), F.col("word").alias("target"), F.col("n").alias("other_n"))
    met = merges.where("kind <> 'open'").join(ends, "target")
    sides = F.array(
        F.struct("name", F.struct((-F.col("other_n")).alias("minus"), F.col("target").alias("word")).alias("best")),
        F.struct(F.col("other").alias("name"), F.struct((-F.col("n")).alias("minus"), "word").alias("best")),
    )
    one = met.select(F.explode(sides).alias("x")).select("x.name", F.lit(1).cast("bigint").alias("k"), "x.best")
    # Light siblings with one rest differ in one character, so a group has no more words than the alphabet.
    group = merges.where("kind = 'open'").groupBy("depth", "target").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "word", "name"))).alias("g")).where(F.size("g") > 1)
    each = group.select(F.explode("g").alias("x"), F.size("g").cast("bigint").alias("k"), F.col("g")[0].alias("first"), F.col("g")[1].alias("second"))
    best = F.when(F.col("x.name") == F.col("first.name"), F.col("second")).otherwise(F.col("first"))
    many = each.select("x.name", (F.col("k") - 1).alias("k"), best.alias("b")).select("name", "k", F.struct("b.minus", "b.word").alias("best"))
    return one.unionByName(many).groupBy("name").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling over (word, form); counts rise by ``TIMES`` a step, so chains are short."""
    up = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = cut(up.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def group_variants(counts: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct words of ``counts`` (word, n)."""
    tune(counts.sparkSession)
    words = cut(counts.select(F.monotonically_increasing_id().alias("name"), "word", "n"))
    found = words.join(near_words(words), "name", "left")
    is_form = -F.col("best.minus") >= TIMES * F.col("n")
    found = cut(
        found.select(
            "word",
            F.when(is_form, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(is_form, -F.col("best.minus")).alias("form_n"),
        )
    )
    roots = _roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
