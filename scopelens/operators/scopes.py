"""Scope predicates as column expressions, so that they reach the scan."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_scope(field: str, allowed: list[str] | None) -> Column:
    """``field`` in the allowed values; no or an unknown scope admits all rows."""
    return F.col(field).isin(*allowed) if allowed else F.lit(True)


def disjunctive(terms: list[tuple[str, str, str]]) -> Column:
    """(field, ``contains`` or ``=``, value) terms, ORed."""
    one = lambda f, op, v: F.col(f).contains(v) if op == "contains" else F.col(f) == v
    return reduce(operator.or_, [one(*t) for t in terms]) if terms else F.lit(True)


def optional(**wanted) -> Column:
    """Equality on the given fields; those that are None don't restrict."""
    return reduce(operator.and_, [F.col(k) == v for k, v in wanted.items() if v is not None], F.lit(True))
