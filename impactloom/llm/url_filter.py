"""URL filter: host and path rules, and a character language-model ratio where no rule fits.

Two smoothed variable-order Markov models are counted, one over URLs that the rules allow and one
over those that they block.  Contexts of three symbols down to none are interpolated by Witten-Bell
weights: how often a context was seen against how many symbols followed it.  The models read whole URLs,
scheme and query included.  A URL's score is the difference of its log-likelihoods per symbol; the least score that is allowed is calibrated on a
held-out fifth of the rules' URLs: the middle of the limits with the best balanced accuracy.

With 41 symbols a model has 41^4 counts at most (11 MB as floats), whatever the table's size; that
is what is gathered and broadcast.  Null URLs and those without :// have an empty host and path, fit
no rule; null ones are scored as empty.  Without URLs of both kinds every score and the limit are 0, so
everything is allowed.  A score that ties with the limit is allowed; of two rules of one length that fit,
the first listed counts.  Repeated rows are judged alike, a URL of any length is read whole, an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, UPPER

# The rules (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SYMBOLS, ORDER = 41, 3
_BINS, _WIDEST = 2_000, 4.0  # of the histogram that calibrates

_CODE = np.full(256, SYMBOLS - 1, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789.-/"):
    _CODE[ord(_c)] = _i + 1  # 0 is the edge of a URL


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = None, None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return rule, verdict


def _cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Context-and-symbol cells of all URLs, edges included, and the first one of each URL."""
    parts, sizes = [], []
    pad = np.zeros(ORDER, np.int64)
    for t in texts:
        parts += [pad, _CODE[np.frombuffer(t.encode().lower(), np.uint8)], pad[:1]]
        sizes.append(len(parts[-2]) + 1)
    codes = np.concatenate(parts) if parts else pad[:0]
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    place = np.arange(at[-1]) + np.repeat(np.arange(len(sizes)) * ORDER, sizes) + ORDER
    cell = np.zeros(at[-1], np.int64)
    for back in range(ORDER, -1, -1):
        cell = cell * SYMBOLS + codes[place - back]
    return cell, at[:-1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(verdict, text) to (verdict, cell, n), summed over the task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        verdicts, texts = np.asarray(batch.column(0).to_pylist(), object), np.asarray(batch.column(1).to_pylist(), object)
        for v in ("allow", "block"):
            own = texts[verdicts == v].tolist()
            if own:
                cells, n = np.unique(_cells(own)[0], return_counts=True)
                sums.setdefault(v, np.zeros(SYMBOLS ** (ORDER + 1), np.int64))[cells] += n
    for v, dense in sums.items():
        cells = np.flatnonzero(dense)
        yield pa.RecordBatch.from_arrays([pa.array([v] * len(cells)), pa.array(cells), pa.array(dense[cells])], names=["verdict", "cell", "n"])


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell interpolated log-probability of every cell (context and symbol)."""
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(ORDER + 1):
        own = counts.reshape(-1, *[SYMBOLS] * (order + 1)).sum(axis=0).astype(np.float64)
        seen, kinds = own.sum(axis=-1, keepdims=True), (own > 0).sum(axis=-1, keepdims=True)
        lower = np.broadcast_to(p, own.shape)
        p = np.where(seen > 0, (own + kinds * lower) / np.maximum(seen + kinds, 1), lower)
    return np.log(p).reshape(-1)


def _scorer(ratio) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch in batches:
            if batch.num_rows:
                cells, starts = _cells(batch.column("lm_text").to_pylist())
                sums = np.add.reduceat(table[cells].astype(np.float64), starts)
                sizes = np.diff(np.append(starts, len(cells)))
                yield batch.drop_columns(["lm_text"]).append_column("score", pa.array(sums / sizes))

    return run


def judge(df: DataFrame, url: str = "url", key: str = "page_id", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row: ``key``, host, path, rule, verdict, score."""
    spark = df.sparkSession
    host, path = host_and_path(F.col(url))
    rows = df.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), F.coalesce(F.col(url), F.lit("")).alias("lm_text"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    ruled = rows.select("key", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), "lm_text")
    held = F.pmod(F.xxhash64("lm_text"), F.lit(5)) == 0
    known = ruled.where("by_rule is not null")
    counted = known.where(~held).select("by_rule", "lm_text").mapInArrow(_count, "verdict string, cell long, n long").groupBy("verdict", "cell").agg(F.sum("n").alias("n")).toArrow()
    dense = {v: np.zeros(SYMBOLS ** (ORDER + 1), np.int64) for v in ("allow", "block")}
    for v, sums in dense.items():
        own = counted.filter(pa.compute.equal(counted["verdict"], v))
        sums[own["cell"].to_numpy()] = own["n"].to_numpy()
    both = all(x.any() for x in dense.values())
    ratio = log_probabilities(dense["allow"]) - log_probabilities(dense["block"]) if both else np.zeros(SYMBOLS ** (ORDER + 1))
    table = spark.sparkContext.broadcast(ratio.astype(np.float32))
    scored = ruled.mapInArrow(_scorer(table), "key long, host string, path string, rule string, by_rule string, score double")
    limit = 0.0
    if both:
        sample = known.where(held).mapInArrow(_scorer(table), "key long, host string, path string, rule string, by_rule string, score double")
        bins = F.least(F.greatest(F.floor((F.col("score") + _WIDEST) / (2 * _WIDEST) * _BINS), F.lit(0)), F.lit(_BINS - 1)).cast("int")
        counts = sample.groupBy("by_rule", bins.alias("bin")).count().collect()  # 2 * _BINS at most
        hist = {v: np.zeros(_BINS) for v in dense}
        for r in counts:
            hist[r["by_rule"]][r["bin"]] = r["count"]
        shares = {v: np.cumsum(h) / max(h.sum(), 1) for v, h in hist.items()}
        gain = shares["block"] - shares["allow"]  # blocked below the bin's end, less what is lost
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        limit = float(((best[0] + best[-1]) / 2 + 1) / _BINS * 2 * _WIDEST - _WIDEST) if gain.max() > 0 else 0.0
    return scored.select(
        F.col("key").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(F.col("score") >= limit, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"),
        "score",
    )
