"""Personal data: fixed patterns, and a bootstrapped contextual extraction of what they miss.

1. Base: every whole text is searched for e-mail addresses, IP addresses, card and phone numbers.
2. Seeds are these spans, and of a fifth kind, ``secret``, values of 16 or more characters with letters and digits that a
   text assigns to a name of credentials (``NAMES``).  A pattern is what stands around a span: the two words before it, the word
   before and the word after, or the word before and the shape of the span (``shape``).  Candidates are the other words with a
   digit or an @; of a word such as ``name="value"`` the value.
3. Patterns and instances (the strings) form a graph.  For a kind, a pattern's confidence is the mean
   confidence of all distinct instances it surrounds, one unknown one added; it counts only with
   ``SUPPORT`` known instances and from ``SURE`` on.  An instance's confidence is the noisy-or of
   its patterns.  Spark scores the two sides in turn, ``ROUNDS`` times.
4. Candidates with a confidence of ``ACCEPT`` or more are added with the best kind, secrets of step 2 too, wherever they stand
   again; base spans stay.

Null texts are empty.  Repeated rows give a row each; an empty table gives an empty result; extra
columns are ignored.  Offsets are code points, ends are exclusive.  Every search is linear in the
text's length.  An instance that is a seed of several kinds in one context counts as the last of them in
``KINDS``; of kinds that an instance supports alike the first is taken.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone", "secret")
#: The kinds of the base; the last one is the method's own.
BASE = 4
SUPPORT, SURE, ACCEPT, ROUNDS = 3, 0.7, 0.85, 3
#: Longer instances and context words are known by their hash.
LONGEST = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
#: Names of credentials, and what may stand between one and its value.
NAMES = "password|passwd|pwd|secret|token|credential|(?:api|access|private|auth|secret)[_ -]?key"
_NAMED = re.compile(rf"(?:{NAMES})s?[\"'`]?\s*(?:=>|:=|=|:)\s*[\"'`]?\Z", re.IGNORECASE | re.ASCII)
_ASSIGNED = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*+[\"'`]?(?:=>|:=|=|:(?!//))[\"'`]?")
_VALUE = re.compile(r"(?=[^A-Za-z]*[A-Za-z])(?=[^0-9]*[0-9])[A-Za-z0-9+/_.~=-]{16,}")
#: A name of credentials stands in so many characters before its value.
NEAR = 48
_ALNUM = re.compile(r"[^\W_]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _nearest(text: str, at: int, step: int, wanted: int) -> list[str]:
    """The ``wanted`` nearest whole words before (step -1) or after (step 1) a place, the nearest first; "" where there are fewer."""
    reach = 64
    while True:
        cut = max(0, at - reach) if step < 0 else min(len(text), at + reach)
        found = (text[cut:at] if step < 0 else text[at:cut]).split()
        # The word at the cut may go on behind it.
        whole = found if cut in (0, len(text)) else found[1:] if step < 0 else found[:-1]
        if len(whole) >= wanted or cut in (0, len(text)):
            return ([_known(w) for w in whole[::step][:wanted]] + [""] * wanted)[:wanted]
        reach *= 4


def shape(instance: str) -> str:
    """``num`` or ``hex`` and the length, or what stands between the letters and digits."""
    if not re.fullmatch("[0-9A-Fa-f]+", instance):
        return _known(_ALNUM.sub("w", instance))
    return f"{'num' if re.fullmatch('[0-9]+', instance) else 'hex'}{len(instance)}"


def patterns(text: str, start: int, end: int) -> list[str]:
    """The patterns around a span: two of words, one of a word and the span's shape."""
    one, two = (w or "^" for w in _nearest(text, start, -1, 2))
    return [f"{two} {one} _", f"{one} _ {_nearest(text, end, 1, 1)[0] or '$'}", f"{one} <{shape(text[start:end])}>"]


def is_secret(text: str, start: int, end: int) -> bool:
    """Whether a candidate is a value that a name of credentials is given."""
    return end - start >= 16 and _NAMED.search(text[max(0, start - NEAR) : start]) is not None and _VALUE.fullmatch(text, start, end) is not None


def _words(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of words with a digit or an @ that meet no taken span."""
    done, k = 0, 0
    for hint in _HINT.finditer(text):
        at = hint.start()
        if at < done:
            continue
        start, end = at, at + 1
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        done = end
        while k < len(taken) and taken[k][2] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        while end > start and text[end - 1] in ".,;:!?)]}\"'*&$%#|":
            end -= 1
        while start < end and text[start] in "([{\"'*&$%#|":
            start += 1
        named = _ASSIGNED.match(text, start, end)
        if named and end - named.end() >= 4:
            start = named.end()
        if end - start >= 4:
            yield start, end


def _known(text: str) -> str:
    text = text.lower()
    return text if len(text) <= LONGEST else "sha256 " + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_ROW = "row string, id long, n array<long>, base string, found array<struct<kind:int,start:long,end:long,instance:string,patterns:array<string>>>"
_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts, rows = batch.column("text"), []
        for i in range(len(texts)):
            text = texts[i].as_py() or ""
            spans, found = [], []
            if _HINT.search(text):
                spans = base_spans(text)
                found = [(k, s, e) for s, k, e in spans]
                found += [(BASE if is_secret(text, s, e) else None, s, e) for s, e in _words(text, spans)]
            counts = [sum(k == c for _, k, _ in spans) for c in range(BASE)]
            told = [{"kind": k, "start": s, "end": e, "instance": _known(text[s:e]), "patterns": patterns(text, s, e)} for k, s, e in found]
            rows.append((f"{part}:{n}", counts, _told(spans), told))
            n += 1
        names, counts, base, found = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), batch.column("id"), pa.array(counts, pa.list_(pa.int64())), pa.array(base, pa.string()), pa.array(found, _FOUND)],
            names=["row", "id", "n", "base", "found"],
        )


def _bootstrap(occurrences: DataFrame) -> DataFrame:
    """(instance, kind, confidence, sure) of candidates, from occurrences (kind, instance, pattern).

    A confidence can be 1 in doubles; ``sure`` still tells such ones apart.
    """
    edges = cut(occurrences.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")))
    # Only patterns around enough seeds can ever start; all their instances are kept, and those instances' other patterns.
    known = edges.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("confidence")).distinct()
    seeds = known
    sizes = cut(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= SUPPORT))
    candidates = edges.where("seed is null").select("pattern", "instance")
    for _ in range(ROUNDS):
        scored = (
            edges.select("pattern", "instance")
            .join(known, "instance")
            .groupBy("pattern", "kind")
            .agg(F.sum("confidence").alias("mass"), F.count(F.lit(1)).alias("support"))
            .where(F.col("support") >= SUPPORT)
            .join(sizes, "pattern")
            .withColumn("belief", F.col("mass") / (F.col("size") + 1))
            .where(F.col("belief") >= SURE)
        )
        sure = -F.sum(F.log1p(-F.least("belief", F.lit(0.999))))
        new = cut(candidates.join(scored, "pattern").groupBy("instance", "kind").agg(sure.alias("sure")).withColumn("confidence", 1 - F.exp(-F.col("sure"))))
        known = seeds.unionByName(new.select("instance", "kind", "confidence"))
    again = seeds.where(F.col("kind") == BASE).withColumn("sure", F.lit(float("inf")))
    return new.where(F.col("confidence") >= ACCEPT).unionByName(again)


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: ``key``, n_email, n_ip, n_card, n_phone (of the base), base, spans.

    ``base`` and ``spans`` list kind:start:end by start, then kind; spans has secrets and the discovered ones too.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    seen = cut(rows.mapInArrow(_extract, _ROW))
    each = seen.select("row", F.explode("found").alias("x")).select("row", "x.*")
    accepted = cut(_bootstrap(each.select("kind", "instance", F.explode("patterns").alias("pattern"))))
    best = accepted.groupBy("instance").agg(F.max(F.struct("confidence", F.round("sure", 9).alias("s"), (-F.col("kind")).alias("k"))).alias("b")).select("instance", (-F.col("b.k")).alias("by"))
    more = each.where("kind is null").join(best, "instance").groupBy("row").agg(F.collect_list(F.struct("start", F.col("by").alias("kind"), "end")).alias("more"))
    names = F.array(*[F.lit(k) for k in KINDS])
    seeds = F.transform(F.filter("found", lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    every = F.sort_array(F.concat(seeds, F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))))
    told = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return seen.join(more, "row", "left").select(
        F.col("id").alias(key), *[F.get("n", F.lit(i)).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])], "base", told.alias("spans")
    )
