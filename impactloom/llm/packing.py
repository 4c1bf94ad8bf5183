"""Bounded-space online packing of documents into token sequences.

Every partition packs its own documents as they come, with ``windows`` open windows at most.  A
document's ids (those of the tokenizer, and the id that ends a document) are cut into full
sequences and a rest; the rest goes into the open window where it fits best.  If it fits in none
and no window may be opened, the fullest is emitted: topped up by the head of the rest if at least
``min_cut`` ids are missing, else padded.  At the end of a partition its open windows are poured
together, which leaves one partial sequence at most; those of ``merge`` neighbouring partitions
are poured together once more by a grouped job over their few pieces.

A null text is empty and has the ending id alone.  Repeated rows are packed each; identifiers are
only carried.  An empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back

SEQUENCE = 4096
ID_BYTES = 4  # ids are little-endian unsigned 32-bit integers
_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Remembered words, and the longest one that is remembered.
MEMO_WORDS, MEMO_CHARS = 1_000_000, 48
#: Lower case does not change these texts' ids: all characters are composed, and each has one lower-case form.
_PLAIN = re.compile("[\x00-\u012f\u0131-\u02ff]*")
_LETTERS = re.compile("[a-z]+").fullmatch


def _worker_memory() -> dict:
    """A dictionary that lasts as long as the Python worker, over its tasks."""
    return sys.modules.setdefault("impactloom_worker_memory", types.ModuleType("impactloom_worker_memory")).__dict__


def forget() -> None:
    """Give the tokenizer's and the words' memory back to the system."""
    _worker_memory().clear()
    give_back()


#: What a tokenizer's file must say for words to be told apart at blanks and met in lower case.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITS_AT_BLANKS = "[^\\s\\p{L}\\p{N}]+"


def check_tokenizer(path: str) -> None:
    """Refuse a file whose tokenizer does not lower-case, or joins words across blanks: its ids would be wrong without a sign."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    steps = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = steps[0] if steps else {}
    pattern = split.get("pattern", {}).get("Regex", "")
    bytes_after = [x.get("type") for x in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    splits = split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and pattern.endswith(_SPLITS_AT_BLANKS) and bytes_after
    if told.get("normalizer") != _NORMALIZER or not splits or told.get("post_processor") or told.get("model", {}).get("type") != "BPE":
        raise ValueError(f"{path}: packing needs a BPE tokenizer that lower-cases and splits at blanks")


def token_bytes(path: str, memo_words: int = MEMO_WORDS) -> Callable[[str], bytes]:
    """A function from a text to its ids as bytes, for tokenizers that lower-case and never join across blanks.

    The tokenizer meets each word between blanks (space or newline) once, and lower case of texts
    where that is sure to be the tokenizer's own.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    memory = _worker_memory()
    if memory.get("path") != path:
        check_tokenizer(path)
        memory.update(path=path, tokenizer=Tokenizer.from_file(path), words={})
    tokenizer, memo = memory["tokenizer"], memory["words"]

    bpe = tokenizer.model
    packers = [struct.Struct(f"<{n}I").pack for n in range(64)]

    def packed(ids: list[int]) -> bytes:
        return packers[len(ids)](*ids) if len(ids) < len(packers) else np.asarray(ids, "<u4").tobytes()

    def learn(words: set[str]) -> None:
        """A word of a-z is one piece, for which the model alone is asked; a mark behind it is the next piece."""
        others = []
        for w in words:
            letters = w[:-1] if w[-1] in ",." else w
            if not _LETTERS(letters):
                others.append(w)
                continue
            if letters not in memo:
                memo[letters] = packed([t.id for t in bpe.tokenize(letters)])
            if letters is not w:
                memo[w] = memo[letters] + memo[w[-1]]
        for w, x in zip(others, tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            memo[w] = packed(x.ids)

    def reset() -> None:
        memo.clear()
        memo[""] = b""
        learn({" ,", " ."})
        memo.update({",": memo.pop(" ,"), ".": memo.pop(" .")})

    if not memo:
        reset()

    def ids(text: str) -> bytes:
        parts = (text.lower() if _PLAIN.fullmatch(text) else text).replace("\n", " ").split(" ")
        new = set(parts).difference(memo)
        if len(memo) + len(new) > memo_words:
            reset()
            new = set(parts).difference(memo)
        if new:
            learn(new)
        out = b"".join(map(memo.__getitem__, parts))
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out

    return ids


class _Windows:
    """Open windows of one task; emitted pieces gather in ``out``."""

    def __init__(self, first_sequence: int, size: int, windows: int, min_cut: int) -> None:
        self.next, self.size, self.windows, self.min_cut = first_sequence, size, windows, min_cut
        self.open: list[tuple[int, list[tuple]]] = []  # (ids in it, pieces (doc, start, ids, doc_tokens))
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // ID_BYTES
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, step = len(ids) // ID_BYTES, self.size * ID_BYTES
        full = len(ids) // step * step
        for i in range(0, full, step):
            self.emit([(doc, i // ID_BYTES, ids[i : i + step], total)])
        if len(ids) > full:
            self.place((doc, full // ID_BYTES, ids[full:], total))

    def place(self, piece: tuple) -> None:
        doc, start, ids, total = piece
        n = len(ids) // ID_BYTES
        fits = [(used, i) for i, (used, _) in enumerate(self.open) if used + n <= self.size]
        if fits:
            used, i = max(fits)
            self.open[i][1].append(piece)
            self.open[i] = (used + n, self.open[i][1])
            if used + n == self.size:
                self.emit(self.open.pop(i)[1])
        elif len(self.open) < self.windows:
            self.open.append((n, [piece]))
        else:
            used, i = max((used, i) for i, (used, _) in enumerate(self.open))
            pieces, gap = self.open.pop(i)[1], self.size - used
            if gap >= self.min_cut:
                pieces.append((doc, start, ids[: gap * ID_BYTES], total))
                start, ids = start + gap, ids[gap * ID_BYTES :]
            self.emit(pieces)
            self.place((doc, start, ids, total))

    def pour(self) -> list[tuple]:
        """Pours the open windows together; returns the pieces of the partial one that is left."""
        left: list[tuple] = []
        room = self.size
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for doc, start, ids, total in pieces:
                while ids:
                    now = ids[: room * ID_BYTES]
                    left.append((doc, start, now, total))
                    start, ids, room = start + len(now) // ID_BYTES, ids[len(now) :], room - len(now) // ID_BYTES
                    if not room:
                        self.emit(left)
                        left, room = [], self.size
        self.open = []
        return left


def _table(rows: list[tuple], ids: list[bytes | None], part: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    arrays = [pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.binary()), pa.array([part] * len(rows), pa.int64())], names=[*names, "ids", "part"])


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    key: str = "doc_id",
    end_id: int = 2,
    size: int = SEQUENCE,
    windows: int = 64,
    min_cut: int = 16,
    merge: int = 64,
    memo_words: int = MEMO_WORDS,
    keep_memory: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a ``tokenizers`` file that every executor can read.  A Python worker remembers the
    ids of ``memo_words`` words from task to task; without ``keep_memory`` it gives that memory, and the
    tokenizer's, back at the end of each task, for jobs that have other work for the worker.
    """
    ending = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state, encode = _Windows(part << 32, size, windows, min_cut), token_bytes(tokenizer, memo_words)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                state.add(doc, encode(text.as_py() or "") + ending)
                if len(state.out) >= 20_000:
                    yield _table(state.out, [None] * len(state.out), part)
                    state.out = []
        left = state.pour()
        if state.out:
            yield _table(state.out, [None] * len(state.out), part)
        if left:
            yield _table([(d, s, len(b) // ID_BYTES, 0, t, 0, 0) for d, s, b, t in left], [b for _, _, b, _ in left], part)
        if not keep_memory:
            del encode
            forget()

    def again(pieces: pa.Table) -> pa.Table:
        rows = pieces.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending")]).to_pylist()
        state = _Windows((1 << 62) + (rows[0]["part"] // merge << 32), size, windows, min_cut)
        state.open = [(0, [(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in rows])]
        left = state.pour()
        if left:
            state.emit(left)
        return pa.Table.from_batches([_table(state.out, [None] * len(state.out), 0)]).drop_columns(["ids", "part"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packed = cut(rows.mapInArrow(run, f"{_FIELDS}, ids binary, part long"))
    done = packed.where("ids is null").drop("ids", "part")
    rest = packed.where("ids is not null")
    merged = rest.groupBy(F.floor(F.col("part") / merge).alias("__group")).applyInArrow(again, _FIELDS)
    return done.unionByName(merged)
