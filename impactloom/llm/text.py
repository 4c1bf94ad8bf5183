"""Column expressions over text: ASCII lower case, words, word shingles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters between words.
BLANKS = "[\\x20\\x09-\\x0D]+"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often body names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, k: int) -> Column:
    """The hashes of all ``k``-word shingles in order, repeats included.

    Fewer than ``k`` words make one shingle of them all; no words make none.
    """

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
        each = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + F.lit(j)) for j in range(k)]))
        few = F.array(F.xxhash64(F.concat_ws(" ", w)))
        return F.when(F.size(w) >= k, each).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>"))

    return let(words(ascii_lower(text)), of)
