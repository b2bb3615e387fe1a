"""SentencePiece models in the tokenizers library.

The model file is a protobuf message; a small reader takes pieces, scores,
types and settings from it. From these the same tokenizer is rebuilt with the
tokenizers library: the normaliser with its white-space marker, the unigram
scores (or, for a merge model, its merges by score), byte fallback and the
decoder. Texts are encoded in batches by the library's threads, and the
results can be compared with the original library's.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from hireloom.llm.id_cache import IdCache
from hireloom.llm.shared import bounded_batches

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# Fixed values of the format: field numbers, types of pieces and kinds of models.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
TEXT, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
KIND, BYTE_FALLBACK, UNKNOWN_ID = 3, 35, 40
UNIGRAM, MERGES = 1, 2
CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE = 2, 3, 4, 5
# End of the fixed values.


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) if wire != 2 else varint()
        if size is None:
            raise ValueError(f"wire type {wire} in a model file")
        yield number, message[at : at + size]
        at += size


@dataclass(frozen=True)
class PieceModel:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unknown: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool

    @staticmethod
    def read(raw: bytes) -> PieceModel:
        pieces, trainer, norm = [], {}, {}
        for number, value in fields(raw):
            if number == PIECES:
                f = dict(fields(value))
                score = float(np.frombuffer(f.get(SCORE, b"\0" * 4), "<f4")[0])
                pieces.append((f[TEXT].decode(), score, f.get(TYPE, NORMAL)))
            elif number == TRAINER:
                trainer = dict(fields(value))
            elif number == NORMALIZER:
                norm = dict(fields(value))
        return PieceModel(
            pieces, trainer.get(KIND, UNIGRAM), bool(trainer.get(BYTE_FALLBACK, 0)), trainer.get(UNKNOWN_ID, 0),
            norm.get(CHARSMAP, b""), bool(norm.get(DUMMY_PREFIX, 1)), bool(norm.get(EXTRA_SPACES, 1)), bool(norm.get(ESCAPE, 1)),
        )

    def merges(self) -> list[tuple[str, str]]:
        """Every way to make a piece of two others, in the order in which the original merges: best score first."""
        ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED, UNUSED)}
        found = []
        for piece, i in ids.items():
            for at in range(1, len(piece)):
                if piece[:at] in ids and piece[at:] in ids:
                    found.append((-self.pieces[i][1], i, ids[piece[:at]], ids[piece[at:]]))
        return [(self.pieces[a][0], self.pieces[b][0]) for _, _, a, b in sorted(found)]

    def splits_at_marks(self) -> bool:
        """Whether no piece has a mark behind another character, so that words can be encoded alone."""
        return not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t == NORMAL)

    def build(self) -> Tokenizer:
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        elif self.kind == MERGES:
            vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocabulary, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model kind {self.kind}")
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if steps:
            out.normalizer = normalizers.Sequence(steps)
        if self.splits_at_marks():
            # A word and the marks before it: shorter strings to merge, and the library's word cache helps.
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return out


class Encoder:
    """Encodes batches of texts; where words can be encoded alone, only the new words of a batch are."""

    def __init__(self, model: PieceModel):
        self.tokenizer, self.by_word = model.build(), model.splits_at_marks()
        self.plain = model.escape and not model.charsmap and not model.squeeze
        self.prefix = MARK if model.dummy_prefix else ""
        self.words = Tokenizer(self.tokenizer.model)
        # Marks become spaces in the whole text: the decoder would make a new string of every piece.
        self.tokenizer.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
        self.sizes = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in model.pieces], np.int64)
        self.known = IdCache(1_000_000)

    def _normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", MARK) if self.plain else self.tokenizer.normalizer.normalize_str(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; an empty one has none, though the prefix mark would give one."""
        if not self.by_word:
            batch = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids if t else [], np.uint32) for e, t in zip(batch, texts, strict=True)]
        self.known.trim()
        split = [_WORDS.findall(self._normal(t)) if t else [] for t in texts]
        flat = [*chain.from_iterable(split)]
        known = self.known
        new = [w for w in dict.fromkeys(flat) if w not in known]
        self._add(new)
        which = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        ids, ends = self.known.gathered(which).astype(np.uint32), np.cumsum(self.known.size[which])
        cuts = np.append(0, ends)[np.cumsum([len(words) for words in split])]
        return np.split(ids, cuts[:-1])

    def _add(self, new: list[str], group: int = 256) -> None:
        """Encode new words in sequences of many; the bytes behind the ids tell where each word ends."""
        groups = [new[i : i + group] for i in range(0, len(new), group)]
        found = self.words.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)
        lists = [e.ids for e in found]
        ids = np.fromiter(chain.from_iterable(lists), np.int32, sum(map(len, lists)))
        ends = np.cumsum(self.sizes[ids])
        wanted = np.cumsum(np.fromiter((len(w.encode()) for w in new), np.int64, len(new)))
        last = np.searchsorted(ends, wanted)
        if len(ends) and last[-1] == len(ends) - 1 and (ends[last] == wanted).all():
            self.known.add_flat(new, ids, np.diff(last + 1, prepend=0))
        else:  # a piece that stands for more or fewer bytes, such as the unknown one
            self.known.add_all(new, [e.ids for e in self.words.encode_batch_fast(new, add_special_tokens=False)])

    def decode(self, lists: list[list[int]]) -> list[str]:
        """The texts of lists of ids, as the whole tokenizer gives them."""
        texts = [x.replace(MARK, " ") for x in decoded(self.tokenizer, lists)]
        return [x[1:] if x.startswith(" ") else x for x in texts] if self.prefix else texts

    def plain_text(self, text: str) -> str:
        """What a text decodes to if nothing is lost."""
        out = self._normal(text).replace(MARK, " ") if text else ""
        return out[1:] if self.prefix and out else out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(PieceModel.read(Path(path).read_bytes()))


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    return PieceModel.read(Path(path).read_bytes()).build()


@lru_cache(maxsize=2)
def original(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = False, digest: bool = False, batch_chars: int = 1 << 20) -> DataFrame:
    """One row per input row: ``id_col``, ``n_tokens`` and ``ids``.

    With ``digest`` ``ids_crc32`` (of the little-endian 32-bit ids) stands in
    for the list. With ``verify`` three columns follow: ``parity``, whether
    the original library gives the same ids; ``n_differing``, how many places
    differ; ``round_trip``, whether the whole list decodes to the normalised
    text and to what the original library decodes from its own.

    A null or empty text has no ids and agrees. Null and repeated ids are
    allowed; an empty table gives no rows; other columns are ignored.
    ``model_path`` must exist on every executor. Batches hold about
    ``batch_chars`` characters and at least one text.
    """

    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        known = encoder(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size < batch_chars:
                    size, to = size + len(texts[to]), to + 1
                yield encoded(batch.column(0).slice(at, to - at), texts[at:to], known)
                at = to

    def encoded(doc_ids: pa.Array, texts: list[str], known: Encoder) -> pa.RecordBatch:
        found = known.encode(texts)
        columns = {"id": doc_ids, "n_tokens": pa.array([len(f) for f in found], pa.int64())}
        if digest:
            columns["ids_crc32"] = pa.array([zlib.crc32(f.astype("<u4").tobytes()) for f in found], pa.int64())
        else:
            columns["ids"] = pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))
        if verify:
            ref = original(model_path)
            mine, other = [f.tolist() for f in found], ref.encode(texts, num_threads=1)
            same = [a == b for a, b in zip(mine, other, strict=True)]
            columns["parity"] = pa.array(same)
            columns["n_differing"] = pa.array([0 if s else differing(np.array(a), np.array(b)) for s, a, b in zip(same, mine, other, strict=True)], pa.int64())
            back, theirs = known.decode(mine), ref.decode(other, num_threads=1)
            columns["round_trip"] = pa.array([b == t and b == known.plain_text(x) for b, t, x in zip(back, theirs, texts, strict=True)])
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>") + (", parity boolean, n_differing long, round_trip boolean" if verify else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, shape).withColumnRenamed("id", id_col)


def differing(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    return int((a[:n] != b[:n]).sum()) + abs(len(a) - len(b))


def decoded(tokenizer: Tokenizer, lists: list[list[int]]) -> list[str]:
    return tokenizer.decode_batch(lists, skip_special_tokens=False)


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text``: the texts of lists of ids; null lists give null, empty lists empty texts."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(model_path)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            texts = decoded(tokenizer, [x or [] for x in lists])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else t for x, t in zip(lists, texts, strict=True)], pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", id_col)
