"""Parsing of model output: verdicts, claims, tool calls, routes. All column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_object(text: Column) -> Column:
    """The first brace-delimited stretch without inner braces."""
    return F.regexp_extract(text, r"(\{[^{}]*\})", 1)


def verdict(text: Column, field: str, default: int = 0) -> Column:
    """``field`` of the JSON object in the text; a malformed or missing one gives the default."""
    return F.coalesce(F.get_json_object(first_object(text), f"$.{field}").try_cast("int"), F.lit(default))


def claim_fraction(text: Column) -> Column:
    """The mean of all ``"supported": 0/1`` in the text; null without any."""
    hits = F.regexp_extract_all(text, F.lit(r'"supported"\s*:\s*([01])'), F.lit(1))
    ones = F.size(F.filter(hits, lambda x: x == "1"))
    return F.when(F.size(hits) > 0, ones / F.size(hits))


def tool_calls(text: Column) -> Column:
    """Names and arguments of all ``<tool_call>{...}</tool_call>``; calls that are no JSON objects are left out."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
    parsed = F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda c: c["name"].isNotNull())


def action(text: Column) -> Column:
    """``Action: tool`` and ``Action Input: ...`` of a reasoning step; null without an action."""
    name = F.regexp_extract(text, r"(?m)^Action:\s*([A-Za-z_]+)\s*$", 1)
    arg = F.regexp_extract(text, r"(?m)^Action Input:\s*(.*)$", 1)
    return F.when(name != "", F.struct(name.alias("tool"), F.coalesce(F.get_json_object(arg, "$.query"), arg).alias("input")))


def named_route(answer: Column, catalog: list[str], default: str = "general") -> Column:
    """A catalog name that is the whole first line, else the longest one contained, else the default."""
    line = F.lower(F.trim(F.split_part(answer, F.lit("\n"), F.lit(1))))
    exact = F.coalesce(*[F.when(line == c, c) for c in catalog])
    longest = F.coalesce(*[F.when(F.lower(answer).contains(c), c) for c in sorted(catalog, key=lambda c: (-len(c), c))])
    return F.coalesce(exact, longest, F.lit(default))


def first_name(answer: Column, taxonomy: Sequence[str], default: Column) -> Column:
    """The first name of the taxonomy, in its order, that the answer contains in any case; the default without any."""
    line = F.lower(answer)
    return F.coalesce(*[F.when(line.contains(n.lower()), F.lit(n)) for n in taxonomy], default)


def literal_list(text: Column) -> Column:
    """A Python or JSON list of strings; anything else as a list of itself."""
    return F.coalesce(F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>", {"mode": "PERMISSIVE"}), F.array(text))
