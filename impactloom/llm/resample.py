"""Importance resampling towards a target's distribution of hashed word n-grams.

Features are words and pairs of neighbouring words; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``.  A task
puts the words of a block of texts into a trie: a node below the root is a word, a node below that a word that follows it.
Nodes hold how often they occur and the CRC state of the way that leads to them, so the state of a pair is its parent's, moved on
by a blank and the word.  Counts go from nodes into bucket totals, of which a task returns ``BUCKETS`` at most, and
Spark adds them up over all texts.

The second pass builds the same tries, attaches each node's gain (how much commoner its bucket is in the target), and a
document walks its words' ways through the trie and adds up the gains.  Its weight is the floored mean; with Gumbel noise from its
identifier, the highest scores are a sample drawn with those weights.

A null text is empty, and a text without words has the weight 0; one with fewer words than asked is scored, never drawn.  A null
identifier counts as empty in the noise and comes last among ties.  Repeated identifiers are scored and drawn each.  Long texts are
read whole; an empty table has an empty result, an empty target scores against even buckets.  Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import places
from .blocks import LETTERS, Words, blocks, strings, words
from .common import cut

BUCKETS = 10_000
_BLANK = zlib.crc32(b" ")

@lru_cache(maxsize=4096)
def _mover(length: int) -> np.ndarray:
    """A table [4, 256] that moves a CRC on by ``length`` bytes: XOR what its four bytes give."""
    if length == 1:
        state = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1)
        whole = [np.uint32(b) << np.uint32(8 * k) for k in range(4) for b in range(256)]
        whole = np.array(whole, np.uint32)
        return (state[whole & 255] ^ (whole >> np.uint32(8))).reshape(4, 256)
    half = _mover(length // 2)
    twice = _moved(half.reshape(-1), half[None], np.zeros(1024, np.int64))
    if length % 2:
        twice = _moved(twice, _mover(1)[None], np.zeros(1024, np.int64))
    return twice.reshape(4, 256)


def _moved(state: np.ndarray, tables: np.ndarray, which: np.ndarray) -> np.ndarray:
    """CRCs moved on, each by the table that ``which`` names."""
    out = tables[which, 0, state & 255]
    for k in range(1, 4):
        out = out ^ tables[which, k, (state >> np.uint32(8 * k)) & 255]
    return out


class Trie:
    """The words of a block of texts and the words behind them, as columns of nodes."""

    def __init__(self, w: Words) -> None:
        told = strings(w).dictionary_encode()
        #: The node of each word as it stands in the texts.
        self.word = told.indices.to_numpy().astype(np.int64)
        names = told.dictionary.to_pylist()
        n = len(names)
        self.state = np.array([zlib.crc32(x) for x in names], np.uint32)
        self.count = np.bincount(self.word, minlength=n)
        #: Words with another behind them in their text, and the node of each such pair.
        behind = np.ones(len(self.word), bool)
        behind[w.bounds[1:][w.counts > 0] - 1] = False
        self.at = np.flatnonzero(behind)
        self.pair, ways = pd.factorize(self.word[self.at] * n + self.word[np.minimum(self.at + 1, len(self.word) - 1)])
        parent, child = np.divmod(ways, max(n, 1))
        further = np.array([zlib.crc32(x, _BLANK) for x in names], np.uint32)
        lengths, which = np.unique(np.array([len(x) + 1 for x in names], np.int64), return_inverse=True)
        tables = np.stack([_mover(int(x)) for x in lengths]) if n else np.empty((0, 4, 256), np.uint32)
        self.pair_state = _moved(self.state[parent], tables, which[child]) ^ further[child]
        self.pair_count = np.bincount(self.pair, minlength=len(ways))

    def totals(self, buckets: int) -> np.ndarray:
        """The counts of all nodes by bucket."""
        out = np.zeros(buckets, np.int64)
        np.add.at(out, self.state % buckets, self.count)
        np.add.at(out, self.pair_state % buckets, self.pair_count)
        return out

    def walked(self, gains: np.ndarray) -> np.ndarray:
        """What each word of the texts adds: the gains of its node and of the node of it and the word behind it."""
        out = gains[self.state % len(gains)][self.word]
        out[self.at] += gains[self.pair_state % len(gains)][self.pair]
        return out


def _counter(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in blocks(batch.column(0)):
                total += Trie(words(texts, LETTERS)).totals(buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    return run


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket."""
    part = df.select(F.col(text).alias("text")).mapInArrow(_counter(buckets), "bucket int, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from its counts (bucket, n), in thousandths; ``buckets`` rows at most come to the driver."""
    found = []
    for side in (source, target):
        n = np.zeros(buckets, np.int64)
        for r in side.collect():
            n[r["bucket"]] = r["n"]
        found.append(n)
    s, t = found
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def _weigher(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column("text")):
                w = words(texts, LETTERS)
                n = w.counts
                features = n + np.maximum(n - 1, 0)
                summed = np.append(0, np.cumsum(Trie(w).walked(gain)))[w.bounds]
                weight = np.diff(summed) // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), pa.array(n), pa.array(features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return run


def weights(df: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_weigher(gain), "id long, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """Floored thousandths of Gumbel noise that depends on the identifier and the seed alone."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, seed: int = 7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row's ``key``, n_features, weight, score and rank.

    Drawn are ``percent`` of the rows with at least ``least`` words, those with the highest scores; the rank of others is null.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    scored = cut(weights(docs, gain, text, key).withColumns({"score": F.col("weight") + gumbel(F.col("id"), seed), "row": F.monotonically_increasing_id()}))
    able = F.col("n_words") >= least
    drawn = scored.where(able).count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    ranked = places(scored.where(able), order, "place").withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    others = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).select(F.col("id").alias(key), "n_features", "weight", "score", "rank")
