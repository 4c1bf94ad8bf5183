"""Cross-entropy difference of two matched n-gram models.

The target model is counted over documents that are labelled good, the background model over all
documents, both in the same way, and both interpolate pairs of neighbours with words:

    p(w | v) = MIX * c(v, w) / c(v) + (1 - MIX) * (c(w) + 1/2) / (N + V / 2)

Both share the vocabulary, the V distinct words of all documents and their beginning.  A document's beginning counts as a word, the one before its first word, so no
loss depends on other rows.  A document's score is its background loss per token less its target loss
per token, in nats: the higher, the more it is like the target.

Words and pairs are known by 64-bit hashes; no count is shared between them.  Rows are dealt into blocks
of about ``BLOCK`` bytes of text.  A block sends the counts of its distinct words and pairs, sorted by
hash and cut into ranges; a range's counts are summed over all blocks, and every block gets back the sums
of its own words and pairs, in their order, and scores its rows by them.  So no task holds a model: what is
held is one block's words and pairs or one range's, and both numbers grow with the corpus.  A frequent
word comes once from each block.  The driver gets the text's size, the number of distinct words and the two
models' totals.

Null and empty texts have no tokens and score 0.  Labels for absent documents and repeated labels
change nothing; extra columns are ignored.  Without target documents its counts are all zero; an empty table
gives an empty result.  Repeated rows count each, texts of any length are read whole, and there are no ties.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small

MIX = 0.5
#: Bytes of text in a block, on average.
BLOCK = 12 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLD[65:91] += np.uint64(32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTES = 2 << 20  # of text that are hashed together
_WORDS = 1 << 20  # distinct words that a task gathers before it hands them on


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: The hash of a document's beginning, which is the word before its first one.
BEGINNING = _mixed(np.array([1], np.uint64))[0]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, of their pairs with the word before, and each text's number of words.

    A word's hash is a polynomial over its bytes, A-Z folded, taken from running sums: no loop over words.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(_BLANK[data], prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    power = np.full(len(data), _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_FOLD[data] * power)])
    back = np.full(len(data), _INVERSE, np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    hashes = _mixed((sums[ends] - sums[starts]) * back[starts])
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, first)
    before = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]]) if len(hashes) else hashes
    counts = np.diff(bounds)
    opening = bounds[:-1][counts > 0]
    before[opening] = BEGINNING
    return hashes, _mixed(before * np.uint64(0x94D049BB133111EB) + hashes), counts


def _chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, list[bytes]]]:
    at, size, out = 0, 0, []
    for i in range(len(texts)):
        t = (texts[i].as_py() or "").encode()
        if out and size + len(t) > _BYTES:
            yield at, out
            at, size, out = i, 0, []
        out.append(t)
        size += len(t)
    if out:
        yield at, out


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(target, text) to (word, bytes, n, t): distinct words, and with no word the text's size, the words and beginnings of both models."""
    size, sums, seen = 0, [0, 0], np.zeros(0, np.uint64)

    def row(words: np.ndarray | list, *totals: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), *[pa.array([x] * len(words), pa.int64()) for x in totals]], names=["word", "bytes", "n", "t"])

    for batch in batches:
        target = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for at, texts in _chunks(batch.column(1)):
            hashes, _, counts = tokens(texts)
            counts += counts > 0
            size += sum(map(len, texts)) + len(texts)
            sums[0] += int(counts.sum())
            sums[1] += int(counts[target[at : at + len(texts)]].sum())
            seen = np.union1d(seen, hashes)
            if len(seen) > _WORDS:
                yield row(seen.view(np.int64), 0, 0, 0)
                seen = seen[:0]
    yield row(seen.view(np.int64), 0, 0, 0)
    yield row([None], size, *sums)


def _grams(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct hashes in order, the place of each word, pair and beginning among them, each text's number of words.

    Words come first, then as many pairs, then a beginning for every text with words.
    """
    parts = [tokens(t) for _, t in _chunks(texts)]
    counts = np.concatenate([c for _, _, c in parts]) if parts else np.zeros(0, np.int64)
    opening = np.full((counts > 0).sum(), BEGINNING, np.uint64)
    every = np.concatenate([w for w, _, _ in parts] + [p for _, p, _ in parts] + [opening])
    del parts
    keys, at = np.unique(every, return_inverse=True)
    return keys, at, counts


def _small(counts: np.ndarray) -> bytes:
    """Counts are mostly 0 and 1: packed they take little of the shuffle."""
    return zlib.compress(counts.tobytes(), 1)


def _large(parts: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(map(zlib.decompress, parts.to_pylist())), kind)


def _count(bits: int):
    """(block, id, text, target) of a block to (range, block, keys, n, t); a range's hashes agree in their first ``bits`` bits."""

    def run(block: pa.Table) -> pa.Table:
        keys, at, counts = _grams(block["text"])
        target = block["target"].to_numpy().astype(bool)
        n = np.bincount(at, minlength=len(keys)).astype(np.uint32)
        own = np.repeat(target, counts)
        t = np.bincount(at[np.concatenate([own, own, target[counts > 0]])], minlength=len(keys)).astype(np.uint32)
        of = (keys >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        ends = np.append(first[1:], len(keys))
        cuts = list(zip(first, ends, strict=True))
        return pa.table(
            [
                pa.array(of[first].astype(np.int32)),
                pa.array(np.full(len(first), block["block"][0].as_py(), np.int64)),
                pa.array([keys[i:j].tobytes() for i, j in cuts], pa.binary()),
                *[pa.array([_small(x[i:j]) for i, j in cuts], pa.binary()) for x in (n, t)],
            ],
            names=["range", "block", "keys", "n", "t"],
        )

    return run


def _sum(part: pa.Table) -> pa.Table:
    """The rows of a range with the sums of all blocks in place of their own counts."""
    each = [np.frombuffer(k, np.uint64) for k in part["keys"].to_pylist()]
    _, at = np.unique(np.concatenate(each), return_inverse=True)
    cuts = np.cumsum([0] + [len(k) for k in each])
    out = []
    for c in ("n", "t"):
        # Sums of doubles are exact up to 2^53.
        sums = np.bincount(at, weights=_large(part[c], np.uint32)).astype(np.int64)[at]
        out.append(pa.array([_small(sums[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
    return pa.table([part["block"], part["range"], *out], names=["block", "range", "n", "t"])


def _losses(totals: tuple[int, int], kinds: int):
    """A block's rows and the sums of its words and pairs to the rows' losses."""

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        keys, at, counts = _grams(block["text"])
        known = known.sort_by("range")
        words = int(counts.sum())
        ids, pairs = at[:words], at[words : 2 * words]
        before = np.concatenate([ids[:1], ids[:-1]])
        before[np.cumsum(counts)[counts > 0] - counts[counts > 0]] = at[-1:]
        doc, sums = np.repeat(np.arange(len(counts)), counts), []
        for name, total in zip(("n", "t"), totals, strict=True):
            c = _large(known[name], np.int64)
            if len(c) != len(keys):
                raise ValueError("a block's rows have changed between counting and scoring")
            p = MIX * c[pairs] / np.maximum(c[before], 1) + (1 - MIX) * (c[ids] + 0.5) / (total + kinds / 2)
            sums.append(np.bincount(doc, weights=-np.log(p), minlength=len(counts)))
        n = np.maximum(counts, 1)
        return pa.table(
            [block["id"], pa.array(counts.astype(np.int64)), pa.array(sums[1] / n), pa.array(sums[0] / n), pa.array((sums[0] - sums[1]) / n)],
            names=["id", "n_tokens", "target_loss", "background_loss", "score"],
        )

    return run


def score(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: ``key``, n_tokens, target_loss, background_loss, score.

    ``target`` lists the ``key`` of target documents.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    chosen = cut(target.select(F.col(key).cast("long").alias("id")).where("id is not null").distinct().withColumn("target", F.lit(True)))
    marked = join_small(rows, chosen, ["id"], "left").select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    words = marked.select("target", "text").mapInArrow(_totals, "word long, bytes long, n long, t long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("bytes", "n", "t")])
    kinds, size, *totals = words.agg(F.count("word") + 1, *[F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "n", "t")]).first()
    blocks = -(-size // BLOCK) or 1
    # By the row's values, so a row that is read again is dealt to the same block.
    dealt = marked.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block"), "id", "text", "target")
    bits = max(6, (blocks - 1).bit_length())
    counts = dealt.groupBy("block").applyInArrow(_count(bits), "range int, block long, keys binary, n binary, t binary")
    sums = counts.groupBy("range").applyInArrow(_sum, "block long, range int, n binary, t binary")
    scored = dealt.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_losses(tuple(totals), kinds), "id long, n_tokens long, target_loss double, background_loss double, score double")
    return scored.withColumnRenamed("id", key)
