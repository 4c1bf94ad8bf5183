"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text gives ``STATS`` transformed statistics (logarithms of counts, logits of shares).  A
class has the mean and the covariance of its labelled documents, S, shrunk towards the covariance
of both classes and towards a multiple of the identity.  A score is the logistic function of the
difference of the classes' log densities, Mahalanobis distances from cached Cholesky factors, and
log priors.

Training uses labelled rows whose crc32(identifier) mod 5 is not 0: all of them up to ``TRAIN_ROWS``,
beyond that a sample of about so many by the identifier's hash.  Per class only a count, a sum and a sum
of outer products leave the executors.  Labels, language, source and identifier are
never inputs.  Null and empty texts have statistics like any other; labels that are null are
skipped, a repeated label counts as often as it is there.  Without labels of both classes every
score is the share of label 1, or 0.5 without any label.  Documents with one identifier are each scored
and, if it is labelled, each learned from; there are no ties.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, frugal, join_small

STATS = 16
#: Weights of the common covariance and of the identity in a class covariance.
POOL, RIDGE = 0.1, 0.02
LIMIT = 0.3
#: The documented bound of the labelled rows that a model is fitted on.
TRAIN_ROWS = 200_000

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 sentence mark, 6 symbol
for _s, _k in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\n\r\x0b\x0c", 4), (".,;:?'-", 5)):
    for _c in _s:
        _KIND[ord(_c)] = _k
for _c in range(33, 127):
    if not _KIND[_c]:
        _KIND[_c] = 6
_KIND[128:] = 1  # bytes of other letters


def _logit(share: float, n: int) -> float:
    return float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text."""
    data = text.encode()
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, w = len(data), len(words)
    lengths = np.fromiter(map(len, words), np.int64, w) if w else np.zeros(1, np.int64)
    kinds_of_word = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    packed = len(zlib.compress(data, 1)) if n else 0
    letters = kinds[1] + kinds[2]
    return [
        float(np.log1p(w)),
        float(np.log1p(len(lines))),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        _logit(kinds[2] / max(letters, 1), max(letters, 1)),
        _logit(kinds[3] / max(n, 1), max(n, 1)),
        _logit(kinds[6] / max(n, 1), max(n, 1)),
        _logit(kinds[5] / max(n, 1), max(n, 1)),
        _logit(kinds_of_word / max(w, 1), max(w, 1)),
        _logit(pairs / max(w - 1, 1), max(w - 1, 1)),
        _logit(len(set(lines)) / max(len(lines), 1), max(len(lines), 1)),
        float(np.log1p(packed) - np.log1p(n)),
        float(np.log1p(w / max(len(lines), 1))),
        _logit(sum(x[-1] in ".!?" for x in lines) / max(len(lines), 1), max(len(lines), 1)),
        _logit((lengths <= 3).sum() / max(w, 1) if w else 0.0, max(w, 1)),
        _logit(sum(x.isupper() for x in words[:]) / max(w, 1), max(w, 1)),
    ]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        rows = np.asarray([statistics(texts[i].as_py() or "") for i in range(len(texts))], np.float64).reshape(-1, STATS)
        flat = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * STATS, rows.reshape(-1))
        yield pa.RecordBatch.from_arrays([batch.column("id"), flat], names=["id", "stats"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, stats) to (label, place, value): the task's sums of z z' for z = (1, stats)."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        labels = batch.column(0).to_numpy()
        x = batch.column(1).flatten().to_numpy().reshape(-1, STATS)
        z = np.hstack([np.ones((len(x), 1)), x])
        for c in np.unique(labels):
            own = z[labels == c]
            sums[int(c)] = sums.get(int(c), 0) + own.T @ own
    for c, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.reshape(-1))], names=["label", "place", "value"])


def _inverse(factor: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangular matrix, by forward substitution."""
    out = np.zeros_like(factor)
    for i in range(len(factor)):
        out[i] = (np.eye(len(factor))[i] - factor[i, :i] @ out[:i]) / factor[i, i]
    return out


class Discriminant:
    """Two classes' means, inverted Cholesky factors and priors."""

    def __init__(self, sums: dict[int, np.ndarray]) -> None:
        self.counts = {c: float(m[0, 0]) for c, m in sums.items()}
        self.parts = []
        if len(sums) < 2 or min(self.counts.values()) < 2:
            return
        total = sum(self.counts.values())
        whole = sum(sums.values())
        mean = whole[0, 1:] / total
        common = whole[1:, 1:] / total - np.outer(mean, mean)
        self.scale = np.sqrt(np.maximum(np.diag(common), 1e-9))
        common = common / np.outer(self.scale, self.scale)
        for c in (0, 1):
            n, mu = self.counts[c], sums[c][0, 1:] / self.counts[c]
            own = (sums[c][1:, 1:] / n - np.outer(mu, mu)) / np.outer(self.scale, self.scale)
            shrunk = (1 - POOL - RIDGE) * own + POOL * common + RIDGE * np.eye(STATS) * max(np.trace(own) / STATS, 0.05)
            factor = np.linalg.cholesky(shrunk)
            # The factor is triangular and small: its inverse is found once and kept for all batches.
            self.parts.append((mu / self.scale, _inverse(factor), np.log(np.diag(factor)).sum(), np.log(n / total)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            n = sum(self.counts.values())
            return np.full(len(x), self.counts.get(1, 0.0) / n if n else 0.5)
        logs = []
        for mu, inverse, logdet, prior in self.parts:
            y = inverse @ (x / self.scale - mu).T
            logs.append(prior - logdet - 0.5 * (y * y).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def _scored(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy().reshape(-1, STATS)
            out = batch.drop_columns(["stats"])
            yield out.append_column("score", pa.array(model.scores(x)))

    return run


def _held_out(key: str):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str = "quality", key: str = "doc_id") -> DataFrame:
    """(id, label) of the labels that a model is fitted on."""
    known = cut(labels.where(F.col(label).isin(0, 1)).select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null").where(~_held_out("id")))
    share = min(1.0, TRAIN_ROWS / max(known.count(), 1))
    return known if share == 1 else known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def train(stats: DataFrame, known: DataFrame) -> Discriminant:
    """From (id, stats) and the labels to learn (id, label)."""
    rows = join_small(stats, known, ["id"]).select("label", "stats")
    sums = rows.mapInArrow(_moments, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    size = (STATS + 1) ** 2  # rows are two times this at most
    moments: dict[int, np.ndarray] = {}
    for r in sums:
        moments.setdefault(r["label"], np.zeros(size))[r["place"]] = r["value"]
    return Discriminant({c: m.reshape(STATS + 1, STATS + 1) for c, m in moments.items()})


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", limit: float = LIMIT) -> DataFrame:
    """One row per row: ``key``, held_out, score, predicted (1 if score >= ``limit``, else 0)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    stats = cut(rows.mapInArrow(_stats, "id long, stats array<double>"))
    model = train(stats, training_labels(labels, label, key))
    scored = stats.mapInArrow(_scored(model), "id long, score double")
    return scored.select(F.col("id").alias(key), _held_out("id").alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are predicted good."""
    ids = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    known = training_labels(labels, label, key)
    # Only labelled documents are needed for the model; all are scored on their way to the result.
    labelled = join_small(ids, known.select("id").distinct(), ["id"], "left_semi")
    model = train(labelled.mapInArrow(frugal(_stats), "id long, stats array<double>"), known)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            x = np.asarray([statistics(texts[i].as_py() or "") for i in range(len(texts))], np.float64).reshape(-1, STATS)
            if len(x):
                yield batch.filter(pa.array(model.scores(x) >= limit))

    return docs.mapInArrow(frugal(good), docs.schema)
