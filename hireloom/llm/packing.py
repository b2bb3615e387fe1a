"""Packing of tokenised documents into sequences by best-fit decreasing.

Overlong documents are cut into full windows first. What is left of each, and
every shorter document, is a piece; pieces go, longest first, into the open
window with the least room that still holds them. A segment tree over the
capacities finds it. Pieces are dealt into groups of bounded size, each packed
alone, so no task holds more than one group and none holds a text and a plan.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hireloom.llm.id_cache import IdCache
from hireloom.llm.shared import bounded_batches, caches, claim, slices


_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = b".,;:!?"


@lru_cache(maxsize=1)
def _byte_characters() -> dict[int, str]:
    """The printable character by which a byte-level model names each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return dict(zip(plain, map(chr, plain), strict=True)) | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCache(IdCache):
    """The ids of words under one tokenizer.

    Encodes each new word once. Words are split at ASCII white space, which the
    tokenizer drops, so the ids of a text are those of its words in order. A
    word of Latin letters goes to the tokenizer's model without its normaliser
    and splitter, where a test of both ways at the start shows no difference.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        trial = ["Abc", "tokens", "straße", "ÉLÈVE", "a", "ñandú"]
        self.direct = all(self._letters(w) == self._plain(w) and self._plain(f"{w}.") == self._plain(w) + self._plain(".") for w in trial)

    def _plain(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _letters(self, word: str) -> list[int]:
        word = word.lower()
        if not word.isascii():
            word = "".join(map(_byte_characters().__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(word)]

    def _new(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        if self.direct:
            if _LETTERS.fullmatch(text):
                return self._letters(text)
            if word[-1] in _MARKS and _LETTERS.fullmatch(text, 0, len(text) - 1):
                return self.of(self[word[:-1]]) + self.of(self[word[-1:]])
        return self._plain(text)

    def __missing__(self, word: bytes) -> int:
        return self.add(word, self._new(word))

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, ``end_id`` after each where it is given, and the place behind each text's last."""
        self.trim()
        split = [t.split() if t else [] for t in texts]
        if end_id is not None:
            # No word holds a space, so this name of the end is none.
            end = b" "
            if end not in self:
                self.add(end, [end_id])
            for words in split:
                words.append(end)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        which = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        ends = np.append(0, np.cumsum(self.size[which]))
        return self.gathered(which), ends[np.cumsum(counts)]


_KNOWN: dict[str, WordCache] = {}
caches(_KNOWN)


def _cache(path: str) -> WordCache:
    """One cache for all tasks of a Python worker, while they pack."""
    claim(_KNOWN)
    if path not in _KNOWN:
        _KNOWN[path] = WordCache(Tokenizer.from_file(path))
    return _KNOWN[path]


class OpenWindows:
    """Open windows by their room, in a segment tree over the capacities 1 to ``size``.

    A leaf counts the windows of that room; an inner node tells whether any
    leaf below it has one. ``tightest`` descends to the smallest room that is
    large enough.
    """

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.any = bytearray(2 * self.width)
        self.windows: list[list[int]] = [[] for _ in range(self.width)]

    def put(self, room: int, window: int) -> None:
        if room <= 0:
            return
        self.windows[room].append(window)
        i = room + self.width
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def tightest(self, need: int) -> int:
        """The smallest room of at least ``need`` that an open window has, or 0."""
        i = need + self.width
        if not self.any[i]:
            while True:
                if i <= 1:
                    return 0
                if not i & 1 and self.any[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.width:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.width

    def take(self, room: int) -> int:
        found = self.windows[room].pop()
        if not self.windows[room]:
            i = room + self.width
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return found


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece, longest first, ties by place."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = OpenWindows(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.tightest(need)
        if room:
            window[i] = tree.take(room)
        else:
            window[i], room, opened = opened, size, opened + 1
        offset[i] = size - room
        tree.put(room - need, int(window[i]))
    return window, offset


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, fits boolean"


def _piece_maker(path: str, size: int, end_id: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(path)
        for part in slices(batches, 1):
            ids, ends = cache.encode_all(part.column(1).cast(pa.binary()).to_pylist(), end_id)
            tokens = np.diff(ends, prepend=0)
            cuts = -(-tokens // size)
            doc = np.repeat(np.arange(len(tokens)), cuts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * size
            length = np.minimum(tokens[doc] - start, size)
            at = (ends - tokens)[doc] + start
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            columns = [part.column(0).take(pa.array(doc)), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), pa.array(tokens[doc]), pa.array(length < size)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "fits"])

    return pieces


def packed(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, group_pieces: int = 16_384
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document's ids are those of ``tokenizer_path`` (which drops white space)
    without special tokens, then ``end_id``. A piece holds ids ``start`` to
    ``start + length`` and lies in its sequence from ``offset``; sequences are
    filled from 0 without gaps. A null or empty text is the end id alone. Rows
    with null or repeated ids are packed like others. An empty table gives no
    rows. ``group_pieces`` is the number of pieces packed together: larger
    groups pad a little less.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    groups = max(1, base.count() // group_pieces)
    pieces = base.mapInArrow(_piece_maker(tokenizer_path, size, end_id), _PIECES)
    # A full window is a sequence of its own; the others meet in groups by a hash of their content.
    group = F.pmod(F.xxhash64("doc_id", "ids_crc32", "length"), F.lit(groups))

    def pack(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        loose = np.flatnonzero(table["fits"].to_numpy(zero_copy_only=False))
        order = loose[np.lexsort((table["start"].to_numpy()[loose], table["doc_id"].fill_null(-1).to_numpy()[loose]))]
        window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        window[order], offset[order] = best_fit_decreasing(lengths[order], size)
        full = np.setdiff1d(np.arange(len(lengths)), loose)
        window[full] = (window[order].max() + 1 if len(order) else 0) + np.arange(len(full))
        sequence = (int(table["bin"][0].as_py()) << 40) + window
        out = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return (
        pieces.withColumn("bin", group)
        .groupBy("bin")
        .applyInArrow(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
        .withColumnRenamed("doc_id", id_col)
    )
