"""Lookups and ordered decisions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, values: Mapping[str, str], default: str | None = None) -> Column:
    """The value of ``key``; one branch per distinct value, so it stays inside generated code."""
    by_value: dict[str, list[str]] = {}
    for k, v in values.items():
        by_value.setdefault(v, []).append(k)
    out = F
    for v, keys in by_value.items():
        out = out.when(key.isin(keys), F.lit(v))
    return out.otherwise(F.lit(default))


def first_match(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F
    for condition, name in rules:
        out = out.when(condition, F.lit(name))
    return out.otherwise(F.lit(default))


def all_matches(rules: Sequence[tuple[Column, str]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules]))


def rank_of(key: Column, order: Sequence[str]) -> Column:
    """The place of ``key`` in ``order``; after all others if it is not there."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), key)
    return F.when(place > 0, place).otherwise(F.lit(len(order) + 1))


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole; ``empty`` where whole is 0."""
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return share if empty is None else F.coalesce(share, F.lit(float(empty)))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))
