"""Chat formatting: reply trees to training conversations.

Messages name their parent. Self-joins on ids alone, with no text in them, double how far each message sees
its ancestors, so paths of depth d take log2(d) joins. Leaves rank by the mean score of their path within
their conversation, and the best ``branches`` paths per conversation are formatted, one conversation each.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. A control string inside a text gets a backslash
after its first character, and one that has n backslashes there already gets one more, so no text can end a
turn or open another and reading back is exact. In roles, backslashes and line breaks are escaped.

Defined cases: a null text or role is empty; rows with a null conv_id are one conversation; a message whose parent is missing is a root; repeated rows of
(conv_id, turn) are turns of their own, ordered by role and text; an empty table gives an empty result; other
columns play no part. Ids must be unique within a conversation; links that form a cycle
raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Control strings of this and of other common chat templates.
CONTROL = r"(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\])"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(" + CONTROL + ")", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(" + CONTROL + ")", r"$1$2$3")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("\\\\"), F.lit("\\\x00")), F.lit("\\n"), F.lit("\n"))
    return F.replace(plain, F.lit("\\\x00"), F.lit("\\"))


def as_messages(turns: DataFrame) -> DataFrame:
    """A table of ordered turns as reply chains: (conv_id, id, parent, role, text, score), each row the parent of the next."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(
        "conv_id",
        F.row_number().over(w).cast("bigint").alias("id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def leaf_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(conv_id, leaf, rank, id, back): the messages of the best paths; ``back`` counts from the leaf.

    Level k of the jump tables has the messages that have an ancestor 2^k steps up, that ancestor, and the
    scores on the way, its own included; each level is a self-join of the one before. Leaves climb them from the top level down
    to add up their scores; the chosen ones climb once more and leave a row at every message they pass.
    """
    links = messages.select("conv_id", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    # A parent that is not there makes the message a root.
    there = links.select("conv_id", F.col("id").alias("parent"), F.col("score").alias("gain"))
    rows = links.count()
    level = cut(links.join(there, ["conv_id", "parent"]).select("conv_id", "id", F.col("parent").alias("top"), "gain"), rows)
    jumps = []
    while not level.isEmpty():
        if 1 << len(jumps) > rows:  # no path is longer than there are messages
            raise ValueError("the links between messages form a cycle")
        jumps.append(level)
        above = level.select("conv_id", F.col("id").alias("top"), F.col("top").alias("top2"), F.col("gain").alias("gain2"))
        level = cut(level.join(above, ["conv_id", "top"]).select("conv_id", "id", F.col("top2").alias("top"), (F.col("gain") + F.col("gain2")).alias("gain")), rows)
    scores = links.select("conv_id", "id", "score")
    leaves = scores if not jumps else scores.join(jumps[0].select("conv_id", F.col("top").alias("id")), ["conv_id", "id"], "left_anti")
    leaves = leaves.select("conv_id", F.col("id").alias("leaf"), "id", F.col("score").alias("total"), F.lit(0).cast("bigint").alias("depth"))
    for k, jump in reversed(list(enumerate(jumps))):
        leaves = cut(
            leaves.join(jump, ["conv_id", "id"], "left").select(
                "conv_id", "leaf", F.coalesce("top", "id").alias("id"),
                (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total"),
                (F.col("depth") + F.when(F.col("top").isNull(), 0).otherwise(1 << k)).alias("depth"),
            ),
            rows,
        )
    by = Window.partitionBy("conv_id").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), "leaf")
    chosen = leaves.withColumn("rank", F.row_number().over(by))
    if branches is not None:
        chosen = chosen.where(F.col("rank") <= branches)
    paths = cut(chosen.select("conv_id", "leaf", "rank", F.col("leaf").alias("id"), F.lit(0).cast("bigint").alias("back")), rows)
    for k, jump in reversed(list(enumerate(jumps))):
        step = paths.join(jump, ["conv_id", "id"]).select("conv_id", "leaf", "rank", F.col("top").alias("id"), (F.col("back") + (1 << k)).alias("back"))
        paths = cut(paths.union(step), rows)
    return paths


def format_conversations(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss_spans): spans (start from 0, length) in code points cover assistant texts."""
    kind = dict(messages.dtypes)["conv_id"]
    # A null conversation is one of its own, which joins by equality would lose.
    messages = messages.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00")))
    messages = cut(messages)  # their texts are sorted and shuffled once, not again for every level
    paths = leaf_paths(messages, branches)
    turns = paths.join(messages.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), "role", "text"), paths.conv_id.eqNullSafe(F.col("c")) & (paths.id == F.col("i")))
    parts = turns.select(
        "conv_id", "leaf", "rank", (-F.col("back")).alias("at"),
        F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("loss"),
    )
    whole = parts.groupBy("conv_id", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("at", "head", "body", "loss"))).alias("t"))
    # One fold gives where each text begins; only lengths pass through it.
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(t["head"])
        span = F.struct(start.alias("start"), F.length(t["body"]).alias("length"))
        spans = F.when(t["loss"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"])
        return F.struct((start + F.length(t["body"]) + len(CLOSE)).alias("at"), spans.alias("spans"))

    return whole.select(
        F.nullif(F.col("conv_id"), F.lit("\x00")).cast(kind).alias("conv_id"), "leaf", "rank",
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("t", state, add)["spans"].alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_text``, both parsed from the formatted string alone."""
    turn = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"
    part = lambda k: F.regexp_extract_all("formatted", F.lit(turn), F.lit(k))
    return formatted.withColumn(
        "turns",
        F.transform(
            F.arrays_zip(part(1).alias("role"), part(2).alias("text")),
            lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")),
        ),
    ).withColumn(
        "loss_text",
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), ""),
    )
