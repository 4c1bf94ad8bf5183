"""Document fingerprints by one-permutation MinHash.

Every shingle of a document (five words, A-Z lower-cased) is hashed once; the upper bits choose one of ``BINS`` bins, which keeps
its least hash.  An empty bin takes the value of a bin that is filled: bin and attempt are hashed to a donor until a filled one
comes up (optimal densification), the same way for every document.  The lowest ``BITS`` bits of each bin are packed into the
fingerprint, in hex.  Two of them agree in a bin by chance with a probability of 2 ** -BITS, which the likeness subtracts.

A text without words, and a null one, has an empty fingerprint: like another empty one (1), unlike all others (0).  A text with
fewer than five words is one shingle.  Equal texts have equal fingerprints wherever they stand.  Long texts are read whole, a
block at a time.  An empty table has an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NOT_BLANK, blocks, mixed, shingle_hashes, words
from .common import cut

#: Bins of a fingerprint (a power of two) and bits of a bin (1, 2, 4 or 8).
BINS, BITS = 256, 4
WORDS = 5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(texts: pa.Array, k: int = WORDS, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The codes of each text's bins, after densification, and which texts have any."""
    docs = len(texts)
    doc, h = shingle_hashes(words(texts, NOT_BLANK), k)
    shift = np.uint64(64 - (bins - 1).bit_length())
    least = np.full(docs * bins, _EMPTY, np.uint64)
    np.minimum.at(least, doc * bins + (h >> shift).astype(np.int64), h & ((np.uint64(1) << shift) - np.uint64(1)))
    least = least.reshape(docs, bins)
    filled = least != _EMPTY
    known = filled.any(axis=1)
    out = least.copy()
    d, b = np.nonzero(~filled & known[:, None])
    attempt = 0
    while len(d):
        donor = (mixed((b + bins * attempt).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64)
        got = filled[d, donor]
        out[d[got], b[got]] = least[d[got], donor[got]]
        d, b = d[~got], b[~got]
        attempt += 1
    return (out & np.uint64((1 << bits) - 1)).astype(np.uint8), known


def packed(codes: np.ndarray, known: np.ndarray, bits: int = BITS) -> list[str]:
    """Fingerprints: the codes' bits one after another, in hex."""
    places = np.arange(bits - 1, -1, -1, dtype=np.uint8)
    whole = np.packbits(((codes[:, :, None] >> places) & 1).reshape(len(codes), -1), axis=1)
    return [row.tobytes().hex() if k else "" for row, k in zip(whole, known, strict=True)]


def unpacked(prints: list[str], bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The codes of fingerprints, and which are not empty."""
    known = np.array([bool(p) for p in prints], bool)
    raw = np.frombuffer(b"".join(bytes.fromhex(p) if p else bytes(bins * bits // 8) for p in prints), np.uint8).reshape(len(prints), -1)
    each = np.unpackbits(raw, axis=1).reshape(len(prints), bins, bits)
    return (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2).astype(np.uint8), known


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> np.ndarray:
    """The estimated share of common shingles (0 to 1) of fingerprints in pairs: agreeing bins, less what chance gives."""
    (x, known_x), (y, known_y) = a, b
    chance = 2.0**-bits
    share = np.clip(((x == y).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(known_x & known_y, share, np.where(known_x | known_y, 0.0, 1.0))


def likeness_of(a: Column, b: Column) -> Column:
    """``likeness`` of two columns of fingerprints with four bits a bin: a hex digit is a bin."""
    at = F.sequence(F.lit(1), F.length(a))
    same = F.aggregate(at, F.lit(0), lambda n, i: n + F.when(F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)), 1).otherwise(0))
    share = F.greatest(F.lit(0.0), (same / F.length(a) - 1 / 16) / (1 - 1 / 16))
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(share)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: ``key`` and fingerprint.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), pa.array(packed(*sketches(texts)), pa.string())], ["id", "fingerprint"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", key)


_FIELDS = [("part", pa.int32()), ("place", pa.int32()), ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())]
_DDL = "part int, place int, id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
#: Rows that are finished, and the first and the last of a partition, whose neighbours lie elsewhere.
_WHOLE, _FIRST, _LAST = 0, 1, 2


def _compared(part: int, ids: list, texts: list[str], prints: tuple, following: list[str], next_prints: tuple) -> Iterator[pa.RecordBatch]:
    """Finished rows of texts and the texts that follow them."""
    edited = []
    for t, n in zip(texts, following, strict=True):
        quarter = len(t) // 4
        edited.append(t[: len(t) - quarter] + n[:quarter])
    shas = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    for at, block in blocks(pa.array(edited, pa.large_string())):
        to = at + len(block)
        own, other = tuple(x[at:to] for x in prints), tuple(x[at:to] for x in next_prints)
        theirs = sketches(block)
        n = len(block)
        columns = [[part] * n, [_WHOLE] * n, ids[at:to], [len(t) for t in texts[at:to]], shas[at:to], packed(*own), packed(*theirs), likeness(own, theirs), likeness(own, other), [None] * n]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], schema=pa.schema(_FIELDS))


def _open(part: int, place: int, id_: int | None, text: str, prints: tuple) -> pa.RecordBatch:
    columns = [[part], [place], [id_], [None], [None], packed(*prints), [None], [None], [None], [text]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], schema=pa.schema(_FIELDS))


def _neighbours() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (part, id, text) to ``_FIELDS``: each is compared when the next one comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None  # the row that waits for the next
        for batch in batches:
            if not batch.num_rows:
                continue
            every = batch.column("id").to_pylist()
            for at, block in blocks(batch.column("text")):
                codes, known = sketches(block)
                ids, texts = every[at : at + len(block)], block.to_pylist()
                if held is None:
                    part = batch.column("part")[0].as_py()
                    yield _open(part, _FIRST, ids[0], texts[0], (codes[:1], known[:1]))
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                    codes, known = np.concatenate([held[2], codes]), np.concatenate([held[3], known])
                yield from _compared(part, ids[:-1], texts[:-1], (codes[:-1], known[:-1]), texts[1:], (codes[1:], known[1:]))
                held = ids[-1], texts[-1], codes[-1:], known[-1:]
        if held:
            yield _open(part, _LAST, held[0], held[1], held[2:])

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last rows of partitions with the first of the next."""
    for batch in batches:
        c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        for i in range(batch.num_rows):
            yield from _compared(c["part"][i], [c["id"][i]], [c["text"][i]], unpacked([c["fingerprint"][i]]), [c["next_text"][i]], unpacked([c["next_fingerprint"][i]]))


def edited(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of a changed copy, and how alike they and the next text's are.

    In the copy the last quarter of the characters is replaced by as many from the beginning of the next text, in ascending
    order of ``key`` (null first, ties by a hash of the text, and after the last the first again).  Texts are dealt once, in ranges
    of the order, and each is compared within its range; for the ends of ranges, one row of each range meets the first of the next.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id", "text")
    done = cut(ranged.mapInArrow(_neighbours(), _DDL))
    first, last = done.where(F.col("place") == _FIRST), done.where(F.col("place") == _LAST)
    # A row for each range: its number, and that of the next one that has rows.
    ahead = first.select("part").withColumn("to", F.lead("part").over(Window.orderBy("part")))
    ahead = ahead.join(F.broadcast(first.agg(F.min("part").alias("top")))).select("part", F.coalesce("to", "top").alias("to"))
    other = first.select(F.col("part").alias("to"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    ends = last.select("part", "id", "text", "fingerprint").join(ahead, "part").join(other, "to").drop("to")
    out = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    found = done.where(F.col("place") == _WHOLE).select(*out).unionByName(ends.mapInArrow(_finish, _DDL).select(*out))
    return found.withColumnRenamed("id", key)
