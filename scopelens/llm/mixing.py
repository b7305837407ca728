"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies, target / source size: a whole part
that all get, and a fractional part. A pivotal step takes two units of fractional copies and moves mass from
one to the other, at random in either direction with the probabilities that keep both expectations, until one
of them is integral. Mass is weighed in words, so that a step keeps the words of the pair as well; between
documents of one size it is the textbook rule (sum below 1: one gets all and the other 0; else one gets 1).

1. The documents with more than 1 / ``LONG`` of their source's words, or all of a source with up to ``LONG``
   rows, are folded pair by pair, the longest first. Where the one left is ``FAR`` times as long as the next
   document, it pairs with the unit of all that follow, which have one common fraction, if that unit stays
   between its floor and ceiling either way. A document of more than 1 / ``GREAT`` of its source's words, for
   which the others could not make up so, may shift their copies further, between 0 and ``CAP``, and is rounded
   the only way that they can make up for if there is only one.
2. The others meet in a reduction tree: groups of about ``FAN`` of them, dealt by hash, are folded in the same
   way. Each group leaves one document with a residual, and the residuals form the groups of the next level,
   until one is left, whose residual is rounded with its own probability.

So a document's expected copies are target / source size and its copies are that number's floor or ceiling,
but for the effects of great documents; and a source misses its target by less than one document of at most
1 / ``LONG`` of its words, or by one about as short as its shortest. No document gets more than ``CAP`` copies.

Randomness is a hash of the row, its number among equal rows and the level: reruns agree. Only DataFrame functions
are used. Groups are hash buckets whose number follows the source's row count, so a source with most rows is
spread over many tasks; equal rows are counted before they are shuffled, and then numbered.

Defined cases: a null or empty text has size 0 and is taken zero times; a null source is a source of its own,
last; repeated rows are decided one by one; an empty table gives an empty result; other columns, whatever
their names, only tell rows apart and pass through the mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free

#: Documents per group of the tree, on average; documents of a source that one task folds.
FAN, LONG = 24, 1024
FAR, GREAT = 4, 64
CAP = 3
WEIGHTS = (1, 2, 3)
#: Equal rows that one task numbers.
RUN = 100_000
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, n, source_size, target): all sizes shared by weight; a target stops at ``cap`` times its source.

    ``sizes`` has (source, size, n), n being the rows that it stands for.
    Targets are min(cap * size, level * weight) for the one level at which they add up; in order of
    cap * size / weight the capped sources come first, so running sums give the level.
    """
    per = sizes.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # These windows see one row per source.
    every = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(1))
    k = (F.row_number().over(every) - 1) % len(WEIGHTS)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (k + 1).cast("int")))
    per = per.withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    before = Window.partitionBy(F.lit(1)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "all_size": F.sum("source_size").over(whole),
            "left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "capped": F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)),
        }
    ).withColumn("level", (F.col("all_size") - F.col("capped")) / F.col("left"))
    # The first source that its level doesn't cap fixes the level of all after it.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    return per.select("source", "n", "source_size", F.least(level * F.col("weight"), F.col("source_size") * float(cap)).alias("target"))


def _uniform(*cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / float(1 << 52)


def _step(x: Column, y: Column, u: Column) -> tuple[Column, Column, Column]:
    """A pivotal step between x and y (s: size, f: fraction): whether x is the one decided, whether that one rises, and the other's fraction."""
    ratio = y["s"] / x["s"]
    rise = F.least(1 - x["f"], y["f"] * ratio)  # the most that x can take from y
    fall = F.least(x["f"], (1 - y["f"]) * ratio)  # the most that y can take from x
    up = u * (rise + fall) < fall
    # x becomes integral where its own bound is the lower one.
    x_done = F.when(up, 1 - x["f"] <= y["f"] * ratio).otherwise(x["f"] <= (1 - y["f"]) * ratio)
    moved = F.when(up, rise).otherwise(-fall)
    rest = F.when(x_done, y["f"] - moved / ratio).otherwise(x["f"] + moved)
    return x_done, up == x_done, F.least(F.greatest(rest, F.lit(0.0)), F.lit(1.0))


_NONE = "cast(array() as array<struct<i:int,copies:int>>)"


def _in_turn(items: Column, target: Column, size: Column) -> Column:
    """Step 1 on a source's long documents, longest first: (done: (i, copies); i, s, low, f: the one left; want, size: of all that follow)."""
    listed = F.transform(items, lambda d, k: F.struct(k.alias("i"), d["size"].cast("double").alias("s"), d["u"].alias("u"), d["v"].alias("v"), F.coalesce(F.get(items, k + 1)["size"], F.lit(0)).alias("after")))
    start = F.struct(F.expr(_NONE).alias("done"), F.lit(-1).alias("i"), F.lit(0.0).alias("s"), F.lit(0).alias("low"), F.lit(0.0).alias("f"), (target / size).alias("want"), size.cast("double").alias("size"))

    def add(x: Column, d: Column) -> Column:
        low = F.least(F.floor(x["want"] + _EPS), F.lit(CAP)).cast("int")
        y = F.struct(d["i"].alias("i"), d["s"].alias("s"), low.alias("low"), F.greatest(x["want"] - low, F.lit(0.0)).alias("f"))
        x_done, up, f = _step(x, y, d["u"])
        one, left = (F.when(x_done if k else ~x_done, F.struct(x["i"], x["s"], x["low"])).otherwise(F.struct(y["i"], y["s"], y["low"])) for k in (1, 0))
        settled = F.struct(one["i"].alias("i"), (one["low"] + up.cast("int")).alias("copies"))
        first = x["i"] < 0
        return F.struct(
            F.when(first, x["done"]).otherwise(F.concat(x["done"], F.array(settled))).alias("done"),
            *[F.when(first, y[c]).otherwise(z).alias(c) for c, z in (("i", left["i"]), ("s", left["s"]), ("low", left["low"]), ("f", f))],
            x["want"].alias("want"), (x["size"] - d["s"]).alias("size"), d["after"].alias("after"), d["v"].alias("v"),
        )

    def settle(x: Column) -> Column:
        """The one left against the unit of all that follow."""
        low = F.floor(x["want"] + _EPS)
        up, down = (x["want"] - (1 - x["f"]) * x["s"] / x["size"]), (x["want"] + x["f"] * x["s"] / x["size"])
        near = (up >= low) & (down <= F.least(low + 1, F.lit(CAP)))
        great = x["s"] * GREAT > size
        may_up, may_down = near | (great & (up >= 0)), near | (great & (down <= CAP))
        rises = F.when(may_up & may_down, x["v"] < x["f"]).otherwise(may_up)
        now = (x["s"] >= FAR * x["after"]) & (x["size"] > 0) & (x["f"] > _EPS) & (x["f"] < 1 - _EPS) & (may_up | may_down)
        done = F.concat(x["done"], F.array(F.struct(x["i"].alias("i"), (x["low"] + rises.cast("int")).alias("copies"))))
        return F.struct(
            F.when(now, done).otherwise(x["done"]).alias("done"), F.when(now, -1).otherwise(x["i"]).alias("i"),
            x["s"].alias("s"), x["low"].alias("low"), x["f"].alias("f"),
            F.when(now, F.when(rises, up).otherwise(down)).otherwise(x["want"]).alias("want"), x["size"].alias("size"),
        )

    # An array of one holds the state between the two halves of a step, so that it is computed once.
    return F.aggregate(listed, start, lambda x, d: F.element_at(F.transform(F.array(add(x, d)), settle), 1))


def _in_pairs(items: Column) -> Column:
    """Pivotal steps through a group's documents, longest first: (done: (i, copies) of the decided ones; i, s, low, f: the one left)."""
    listed = F.transform(items, lambda d, k: F.struct(k.alias("i"), d["size"].cast("double").alias("s"), d["low"].alias("low"), d["f"].alias("f"), d["u"].alias("u")))
    one = F.element_at(listed, 1)
    start = F.struct(F.expr(_NONE).alias("done"), *[one[c].alias(c) for c in ("i", "s", "low", "f")])

    def add(x: Column, y: Column) -> Column:
        x_done, up, f = _step(x, y, y["u"])
        settled = F.struct(F.when(x_done, x["i"]).otherwise(y["i"]).alias("i"), (F.when(x_done, x["low"]).otherwise(y["low"]) + up.cast("int")).alias("copies"))
        return F.struct(F.concat(x["done"], F.array(settled)).alias("done"), *[F.when(x_done, y[c]).otherwise(x[c]).alias(c) for c in ("i", "s", "low")], f.alias("f"))

    return F.aggregate(F.slice(listed, 2, F.greatest(F.size(listed) - 1, F.lit(0))), start, add)


_ROW = ("doc_id", "size", "source_size", "target", "key")
_NAME = ("doc_id", "size", "key", "no")


def _tree(rows: DataFrame, most: int, total: int) -> DataFrame:
    """(.., copies) of rows with ``low`` whole copies, the fraction ``f`` and ``n`` rows of their source; most and total: rows of a source and of all."""
    out = []
    for level in range(max(1, math.ceil(math.log(max(most, 2)) / math.log(FAN)))):
        groups = F.greatest(F.ceil(F.col("n") / float(FAN ** (level + 1))), F.lit(1)).cast("bigint")
        bucket = F.pmod(F.xxhash64(F.lit(level), *_NAME), groups)
        item = F.struct((-F.col("size")).alias("order"), _uniform(F.lit("pair"), F.lit(level), *_NAME).alias("u"), *_NAME, "source_size", "target", "low", "f")
        tree = rows.groupBy("source", "n", bucket.alias("bucket")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        tree = cut(tree.select("source", "n", "items", _in_pairs(F.col("items")).alias("x")), total // FAN**level if level else None)
        done = tree.select(F.explode(F.transform("x.done", lambda d: F.struct(F.get("items", d["i"]).alias("d"), d["copies"].alias("copies")))).alias("y"))
        out.append(done.select(*[f"y.d.{c}" for c in _ROW], "y.copies"))
        left = F.get("items", F.col("x.i"))
        rows = tree.select("source", "n", *[left[c].alias(c) for c in (*_NAME, "source_size", "target", "low")], F.col("x.f").alias("f"))
    last = rows.select(*_ROW, (F.col("low") + (_uniform(F.lit("root"), *_NAME) < F.col("f")).cast("int")).alias("copies"))
    for done in out:
        last = last.union(done)
    return last


def _numbered(rows: DataFrame) -> DataFrame:
    """One row for each of the ``m`` equal rows that a row stands for, numbered by ``no``."""
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / RUN))))
    runs = runs.repartition("doc_id", "size", "key", "run")
    return runs.withColumn("no", F.explode(F.sequence(F.col("run") * RUN, F.least("m", (F.col("run") + 1) * RUN) - 1))).drop("m", "run")


def copies_of(sizes: DataFrame) -> DataFrame:
    """(doc_id, source, size, key) to (doc_id, size, source_size, target, key, copies), one row for each row.

    ``key`` comes along for joins and tells rows of equal id and size apart.
    """
    counted = cut(sizes.groupBy("source", "doc_id", "size", "key").agg(F.count("*").alias("m")))
    # Sources are few but not bounded, so whether to broadcast them is left to the size that AQE sees.
    goals = source_targets(counted.select("source", "size", F.col("m").alias("n"))).withColumnRenamed("source", "_source")
    known = _numbered(counted.join(goals, counted.source.eqNullSafe(F.col("_source"))).drop("_source"))
    none = known.where("size = 0").select(*_ROW, F.lit(0).alias("copies"))
    some = known.where("size > 0")
    long = (F.col("size") * LONG > F.col("source_size")) | (F.col("n") <= LONG)
    item = F.struct((-F.col("size")).alias("order"), _uniform(F.lit("turn"), *_NAME).alias("u"), _uniform(F.lit("unit"), *_NAME).alias("v"), *_NAME)
    # At most LONG documents of a source are long.
    turns = some.where(long).groupBy("source", "source_size", "target").agg(F.array_sort(F.collect_list(item)).alias("items"))
    turns = turns.select("source", "source_size", "target", "items", _in_turn(F.col("items"), F.col("target"), F.col("source_size")).alias("x"))
    # The last one is rounded with its own probability; what follows makes up for it as far as it can.
    up = F.get("items", F.col("x.i"))["v"] < F.col("x.f")
    last = F.when(F.col("x.i") >= 0, F.array(F.struct(F.col("x.i").alias("i"), (F.col("x.low") + up.cast("int")).alias("copies"))))
    owed = F.when(F.col("x.i") >= 0, (F.col("x.f") - up.cast("int")) * F.col("x.s")).otherwise(0.0)
    turns = cut(turns.select("source", "source_size", "target", "items", F.concat("x.done", F.coalesce(last, F.expr(_NONE))).alias("done"), (F.col("x.want") + owed / F.nullif(F.col("x.size"), F.lit(0.0))).alias("_want")))
    first = turns.select("source_size", "target", F.explode(F.transform("done", lambda d: F.struct(F.get("items", d["i"]).alias("d"), d["copies"].alias("copies")))).alias("y"))
    first = first.select("y.d.doc_id", "y.d.size", "source_size", "target", "y.d.key", "y.copies")
    left = turns.select(F.col("source").alias("_source"), "_want")
    rest = some.where(~long)
    want = F.least(F.greatest(F.coalesce("_want", F.col("target") / F.col("source_size")), F.lit(0.0)), F.lit(float(CAP)))
    low = F.floor(want + _EPS)
    rest = rest.join(left, rest.source.eqNullSafe(F.col("_source")), "left").select("source", "n", *_NAME, "source_size", "target", low.cast("int").alias("low"), F.greatest(want - low, F.lit(0.0)).alias("f"))
    most, total = goals.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    done = none.union(first)
    return done.union(_tree(rest, most, total)) if most > LONG else done


def _fingerprint(docs: DataFrame) -> Column:
    """128 bits over all columns; those with a map or a variant anywhere inside count as JSON, whose fields keep their order."""

    def part(c: str, kind: str) -> Column:
        if "map<" in kind or "variant" in kind:
            return F.to_json(F.struct(F.col(f"`{c}`")), {"ignoreNullFields": "false"})
        if kind.startswith(("array", "struct")):
            return F.struct(F.col(f"`{c}`"), F.col(f"`{c}`").isNull())
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00null"))

    parts = [part(c, t) for c, t in docs.dtypes]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *reversed(parts)).alias("b"))


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every document."""
    sizes = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), _fingerprint(docs).alias("key"))
    return copies_of(sizes).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed rows themselves: each document as often as it is taken; columns as in ``docs``.

    Rows meet their copies by a fingerprint of all columns. Identical rows are interchangeable: their copies
    are added up and made from one of them.
    """
    key, copies = free(docs, "key"), free(docs, "copies")
    keyed = docs.withColumn(key, _fingerprint(docs))
    sizes = keyed.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.col(key).alias("key"))
    wanted = cut(copies_of(sizes).groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias("rows")).where(F.col(copies) > 0))
    names = [F.col(f"`{c}`") for c in docs.columns]
    taken = lambda rows: rows.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))).select(*names)
    once = taken(keyed.join(wanted.where("rows = 1").drop("rows"), key))
    many = wanted.where("rows > 1").drop("rows")
    return once if many.isEmpty() else once.unionByName(taken(keyed.join(many, key).dropDuplicates([key])))
