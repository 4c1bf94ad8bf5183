"""Text as column expressions: tokens, normal forms, keys, paths, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for each other in requests and artifact names.
SYNONYMS = {
    "cancel": ["cancel", "cancellation", "cancelled"],
    "inventory": ["stock", "reservation", "reserved"],
    "shipment": ["shipping", "shipped", "delivery"],
    "order": ["order", "ordering"],
    "release": ["release", "free", "unlock"],
}
# Fixed value: identifiers in CamelCase or snake_case; word bounds are those of ASCII.
SYMBOL = "(?<![A-Za-z0-9_])([a-zA-Z][a-z]+(?:[A-Z][a-z]+)+|[a-z]+(?:_[a-z]+)+)(?![A-Za-z0-9_])"
# Fixed value: a quoted value that is given to something named like a secret.
SECRET = "(?i)(api[_-]?key|secret|token|password)\\s*[:=]\\s*['\"][^'\"]+['\"]"


def normal_text(c: Column) -> Column:
    """Concept text: lower case, marks dropped, blanks joined."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "[_-]", " "), "[^a-z0-9_ \\t\\n\\r]", ""), "[ \\t\\n\\r]+", " "))


def tokens(c: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Distinct words of three and more letters or digits, CamelCase split, with their synonyms."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "[^a-zA-Z0-9]+", " ")
    words = F.array_distinct(F.filter(F.split(F.lower(spaced), " "), lambda w: F.length(w) > 2))
    for key, others in (synonyms or {}).items():
        group = F.array(*[F.lit(x) for x in [key, *others]])
        words = F.when(F.arrays_overlap(words, group), F.array_union(words, group)).otherwise(words)
    return words


def symbols(c: Column, limit: int = 15) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(SYMBOL), F.lit(1))), 1, limit)


def content_hash(c: Column) -> Column:
    """Hash of a text without trailing blanks on lines and blank lines at either end; null if nothing is left."""
    lines = F.regexp_replace(F.regexp_replace(c, "\\r\\n?", "\n"), "[ \\t]+(?=\n|$)", "")
    body = F.regexp_replace(lines, "^\n+|\n+$", "")
    return F.when(body != "", F.sha2(body, 256))


def uri_component(c: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are."""
    out = F.url_encode(c)
    for was, now in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def artifact_identity(kind: Column, path: Column, symbol: Column) -> Column:
    return F.concat(kind, F.lit(":"), uri_component(path), F.lit("#"), uri_component(symbol))


def canonical_path(c: Column) -> Column:
    """Forward slashes, no . segments, .. resolved; null if the path is absolute or leaves its root."""
    parts = F.filter(F.split(F.regexp_replace(c, "\\\\", "/"), "/"), lambda s: ~s.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        up = s == ".."
        kept = F.when(up, F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0)))).otherwise(F.array_append(acc["p"], s))
        return F.struct(kept.alias("p"), (acc["out"] | (up & (F.size(acc["p"]) == 0))).alias("out"))

    done = F.aggregate(parts, start, step)
    return F.when(~c.startswith("/") & ~done["out"], F.array_join(done["p"], "/"))


def redacted(c: Column) -> Column:
    return F.regexp_replace(c, SECRET, "$1=[REDACTED]")


def label(c: Column, limit: int = 60) -> Column:
    """A diagram label: quotes and line breaks replaced, cut to ``limit`` with an ellipsis."""
    plain = F.regexp_replace(F.regexp_replace(c, '"', "'"), "[\\r\\n]+", " ")
    return F.when(F.length(plain) > limit, F.concat(F.substring(plain, 1, limit - 3), F.lit("..."))).otherwise(plain)


def last_segment(url: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(url, "/"), -1), "\\.git$", "")


def gherkin(c: Column) -> Column:
    """(given, when, then) of a scenario's text; empty where a line is missing."""
    return F.struct(*[F.regexp_extract(c, f"(?im)^\\s*{k}:?\\s*(.*)$", 1).alias(k) for k in ("given", "when", "then")])


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")
