"""Document fingerprints from closed syncmers, by DataFrame functions only.

A run of ``K`` words is a closed syncmer if the least hash of its runs of ``S`` words is that of its first or its
last one. Whether it is depends on the run alone, so an edit moves or changes no anchor beyond ``K`` words from
it, and of ``K - S`` + 1 consecutive runs at least one is an anchor. Anchors are matched by position: an element
of a fingerprint is an anchor together with the distance to the next anchor, which holds wherever in a text the
two stand. The fingerprint is the ``SIZE`` smallest 32-bit hashes of all elements of the whole text (all of them,
if there are fewer), in order, as hexadecimal digits; the likeness of two fingerprints is the share of the
``SIZE`` smallest hashes of both that both have, which estimates how many of all elements of either text are in
both.

Words are what stands between the six signs of white space. A text is its words between two pads of ``K`` / 2 empty
ones, so short texts have anchors as well; hashes are made block by block, each of which looks far enough beyond
its end for the next anchor. A task needs memory for about twelve times the bytes of its longest text.

The next document in descending order of ids comes from a window over ranges of ids. Their bounds are taken
from ids alone, and the few first rows of ranges go to the last rows of those before them by a join of their own.

Defined cases: a null text is empty, and a text without two anchors has one element, the hash of the whole; equal
texts have equal fingerprints, so empty ones have likeness 1; null ids follow all others; rows that share an id
follow each other by a hash of the text, so of repeated rows each but the last is followed by its equal; after
the last row comes the first, which for one row is itself; no row, no result. Other columns pass through; those
named like a result are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, shuffle_partitions

K, S, SIZE = 4, 2, 128
#: Words of a block, and those beyond it that its last anchor's successor may need.
BLOCK = 4096
AHEAD = 2 * K - S + 1
#: Bytes of text that a range of ids is meant to hold; ranges for each shuffle partition at least; ranges at most,
#: since each task gets the bounds of all (some 60 bytes each). Larger ranges are sorted on disk.
RANGE_BYTES, RANGES, MOST_RANGES = 16 << 20, 4, 200_000
#: White space other than the space.
SPACES = "\t\n\v\f\r"


def _let(value: Column, f) -> Column:
    """f(value), where ``value`` is computed once for each row."""
    return F.transform(F.array(value), f)[0]


def _words(text: Column) -> Column:
    """The words of a text between two pads of empty ones."""
    pad = F.array_repeat(F.lit(""), K // 2)
    for c in SPACES:  # one sign is found and split at faster than a class of them
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.concat(pad, F.filter(F.split(text, " "), lambda w: w != ""), pad)


def _anchors(block: Column) -> Column:
    """Places of the closed syncmers of a block of words."""
    runs = F.size(block) - K + 1
    inner = F.transform(F.sequence(F.lit(0), runs + (K - S - 1)), lambda i: F.xxhash64(*[block[i + j] for j in range(S)]))
    wide = K - S + 1
    low = lambda h, i, among: h[i + among[0]] if len(among) == 1 else F.least(*[h[i + j] for j in among])
    closed = lambda h, i: low(h, i, range(1, wide - 1)) >= low(h, i, (0, wide - 1))
    found = _let(inner, lambda h: F.filter(F.sequence(F.lit(0), runs - 1), lambda i: closed(h, i)))
    return F.when(runs > 0, found).otherwise(F.array().cast("array<int>"))


def _smallest(elements: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(elements)), 1, SIZE)


def _short(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0xFFFFFFFF))


def _elements(block: Column) -> Column:
    """The smallest hashes of the block's anchors, each with the distance to the next one."""
    one = lambda x, after: _short(F.xxhash64(*[block[x + j] for j in range(K)], after - x))
    paired = lambda a: F.filter(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), lambda x: x < BLOCK)
    return _smallest(_let(_anchors(block), lambda a: F.transform(paired(a), lambda x, j: one(x, a[j + 1]))))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as sorted 32-bit numbers."""

    def whole(words: Column) -> Column:
        last = F.floor((F.size(words) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: _let(F.slice(words, b * BLOCK + 1, BLOCK + AHEAD), _elements))
        return _smallest(F.flatten(blocks))

    some = _let(_words(F.coalesce(text, F.lit(""))), whole)
    return _let(some, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(_short(F.xxhash64(F.lit("whole"), F.coalesce(text, F.lit("")))))))


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits for each element."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of the elements of either text that are in both, 0 to 1."""
    both = _let(_smallest(F.concat(a, b)), lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))
    return both.cast("double")


def _order() -> Column:
    """Ascending in this order is descending by id, nulls last."""
    doc, key = F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
    return F.struct(doc.isNull().alias("none"), F.coalesce(F.bitwise_not(doc), F.lit(0)).alias("id"), key.alias("key"), F.monotonically_increasing_id().alias("row"))


ORDER = "none boolean, id bigint, key bigint, row bigint"


def _bounds(order: DataFrame, ranges: int) -> list:
    """The least order of each of about so many ranges of equal numbers of rows."""
    dealt = order.repartitionByRange(ranges, "none", "id", "key", "row")
    least = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("none", "id", "key", "row")).alias("least"))
    return [r.least for r in least.orderBy("least").collect()]  # one row for each range


def _range_of(order: Column, bounds: list) -> Column:
    """The number of the range, by bisection of the bounds."""
    table = F.from_json(F.lit(json.dumps([b.asDict() for b in bounds])), f"array<struct<{ORDER}>>")

    def halve(s: Column, _: Column) -> Column:
        middle = ((s["lo"] + s["hi"]) / 2).cast("int")
        below = order < table[middle]
        return F.struct(F.when(below, s["lo"]).otherwise(middle).alias("lo"), F.when(below, middle).otherwise(s["hi"]).alias("hi"))

    ends = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), ends, halve)["lo"]


def with_next(docs: DataFrame, ready: Callable[[DataFrame], DataFrame], following: dict[str, str]) -> DataFrame:
    """``ready(docs)`` with columns of the next row in descending order of ids.

    ``ready`` adds columns row by row; ``following`` gives each column of the next row its name here. Texts are
    shuffled once.
    """
    spark = docs.sparkSession
    order, part, after = (free(docs, c) for c in ("order", "part", "after"))
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)), F.count("*")).first()
    if not rows:
        return ready(docs).select("*", *[F.col(c).alias(n) for c, n in following.items()])
    n = max(shuffle_partitions(spark), size // (RANGES * RANGE_BYTES))
    named = docs.withColumn(order, _order())
    bounds = _bounds(named.select(f"`{order}`.*"), min(rows, RANGES * n, MOST_RANGES))
    # Rows that a bound may name have equal texts, so any of them may stand for the first of its range; equal rows
    # may begin many ranges, but each meets one row here.
    parts: dict[tuple, list[int]] = {}
    for k, b in enumerate(bounds):
        parts.setdefault((b.none, b.id, b.key), []).append(k)
    names = {c: free(docs, f"least_{c}") for c in ("none", "id", "key")}
    least = spark.createDataFrame([(v, *key) for key, v in parts.items()], f"`{after}` array<int>, " + ", ".join(f"`{names[c]}` {t}" for c, t in (("none", "boolean"), ("id", "bigint"), ("key", "bigint"))))
    same = [F.col(f"`{order}`.`{c}`") == F.col(f"`{n}`") for c, n in names.items()]
    heads = ready(named.join(F.broadcast(least), same).drop(*names.values()).dropDuplicates([after]))
    heads = heads.select(F.explode(after).alias(part), *[F.col(c).alias(n) for c, n in following.items()])
    # Never null, so that no filter on it comes between the scan and the exchange, which all parts of the plan share.
    dealt = named.withColumn(part, F.coalesce(_range_of(F.col(order), bounds), F.lit(0))).repartition(n, part)
    w = Window.partitionBy(part).orderBy(order)
    inside = ready(dealt).select("*", *[F.lead(c).over(w).alias(n) for c, n in following.items()], F.lead(part).over(w).alias(after)).where(F.col(after).isNotNull())
    ends = dealt.withColumn(after, F.lead(part).over(w)).where(F.col(after).isNull()).withColumn(part, F.when(F.col(part) + 1 < len(bounds), F.col(part) + 1).otherwise(0))
    return inside.drop(order, part, after).unionByName(ready(ends).join(heads, part).drop(order, part, after))


def compare_edited(docs: DataFrame) -> DataFrame:
    """``docs`` with the text whose last third is that of the next document, both fingerprints and two likenesses."""
    text, own = free(docs, "next"), free(docs, "own")
    docs = docs.drop("edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    rows = with_next(docs, lambda d: d.withColumn("fingerprint", fingerprint(F.col("text"))), {"text": text, "fingerprint": own})
    n = F.length(F.coalesce("text", F.lit("")))
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.coalesce("text", F.lit("")), F.lit(1), n - third), F.substring(F.coalesce(text, F.lit("")), F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    near = {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col(own))}
    return rows.withColumns(near).drop(text, own)
