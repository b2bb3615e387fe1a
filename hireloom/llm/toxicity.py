"""Toxicity of documents after undoing disguised spelling.

A noisy channel explains how a word came to be written: letters swapped for
look-alikes, marks or spaces set between letters, letters repeated. Viterbi
decoding over the lattice of possible letters, under a character trigram model
of all documents, restores the word; a space in a run of pieces is a choice of
the lattice like the others. Restored words are scored by how often their stems
occur in documents labelled toxic.

The character model is counted over every document. Labels are learned from a
bounded sample of the labelled training rows (``train_rows``); every document
is scored whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireloom.llm.shared import bounded_batches, caches, claim, new_folder, remove, slices, written
from hireloom.llm.words import Words, mixed, word_hashes, words_of

# What a character may stand for, and the marks that may be set between letters.
LOOKALIKES = {
    "@": "a", "4": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "#": "h", "1": "il", "!": "i",
    "|": "il", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "2": "z",
}
FILLERS = ".-_*~'`^"
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip(
    "аеорсухіѕјԁһкмтвнαεικνορτυχ",
    "aeopcyxisjdhkmtbhaeikvoptux", strict=True,
))
# End of the fixed values.

SYMBOLS = 28  # 0 edge of a word, 1 to 26 letters, 27 any byte beyond ASCII
COST_LOOKALIKE, COST_FILLER, COST_REPEAT, COST_SPACE = 1.0, 0.5, 0.7, 0.5
BUCKETS = 1 << 20
_PRIOR = 5.0
_TOP = 3
_CACHED = 50_000
_AHEAD = 12  # characters from each piece of a run on that hold its longest stem, marks and repeats included

_SYMBOL_OF = np.zeros(256, np.int64)
for _i in range(26):
    _SYMBOL_OF[[65 + _i, 97 + _i]] = 1 + _i
_SYMBOL_OF[128:] = 27

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = _SYMBOL_OF > 0
_INNER = _LETTER.copy()  # bytes at which a word may end, and all but one also begin
_INNER[[*b"0123456789_@!$+|#"]] = True
_FIRST = _INNER.copy()
_FIRST[ord("(")] = True
_SINGLE = _FIRST.copy()
_SINGLE[128:192] = False  # one count for each character: not for the bytes that go on with it

#: What follows 0xC3 in a Latin letter with a mark, and the plain letter; capitals are 32 before them.
_MARKED = {0x80 + i: ord(c) for i, c in enumerate("aaaaaa-ceeeeiiii-nooooo--uuuuy--aaaaaa-ceeeeiiii-nooooo--uuuuy-y") if c != "-"}
_PLAIN_OF = np.zeros(256, np.uint8)
_PLAIN_OF[list(_MARKED)] = list(_MARKED.values())
_SMALL_OF = np.arange(256, dtype=np.uint8)
_SMALL_OF[[*range(0x80, 0x97), *range(0x98, 0x9F)]] += 32

_EDGE = re.compile(r"^[^\w@!$+(|#]+|[^\w@!$+|#]+$")
_DISGUISED = re.compile(r"[^\W\d_][@$!|+#(0-9]|[@$!|+#(0-9][^\W\d_]|[^\W\d_][.\-_*~'`^]+[^\W_]|([^\W\d_])\1")
_LETTERS = re.compile(r"[^\W\d_]+")
_ASCII_LETTERS = re.compile(rb"[a-z]+")
_REPEATED = re.compile(rb"([a-z])\1+")
_MARKS = re.compile("[\u0300-\u036f]")
_HOMOGLYPHS = str.maketrans(HOMOGLYPHS)
_EDGE_BYTES = re.compile(rb"^[^\w\x80-\xff@!$+(|#]+|[^\w\x80-\xff@!$+|#]+$")


def count_trigrams(texts: list[bytes | None]) -> np.ndarray:
    """Counts of symbol trigrams over texts, as a flat table."""
    s = _SYMBOL_OF[np.frombuffer(b"  ".join(t or b"" for t in texts) + b"  ", np.uint8)]
    codes = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    return np.bincount(codes[(s[1:-1] > 0) | (s[2:] > 0)], minlength=SYMBOLS**3)


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-log p(c | a, b), add-half smoothed."""
    table = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.5
    return -np.log(table / table.sum(2, keepdims=True))


@lru_cache(maxsize=4096)
def _options(ch: str) -> list[tuple[str, float]]:
    """The letters that a character may stand for, and at what cost."""
    if not ch.isalpha():
        return [(c, COST_LOOKALIKE) for c in LOOKALIKES.get(ch, "")]
    if "a" <= ch <= "z":
        return [(ch, 0.0)]
    plain = HOMOGLYPHS.get(ch) or unicodedata.normalize("NFKD", ch)[0].lower()
    return [(ch, 0.0), (plain, COST_LOOKALIKE)] if "a" <= plain <= "z" else [(ch, 0.0)]


def restore(word: str, costs: list, spaces: bool = False) -> str:
    """The cheapest reading: Viterbi over the lattice with the last two letters as state.

    With ``spaces`` a space is an edge between words or, at a cost, nothing.
    """
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    previous = ""
    for ch in word.lower():
        # The empty reading: a mark or space between letters, or one more of the same character.
        if ch == " " and spaces:
            options, skip = [(ch, 0.0)], COST_SPACE
        else:
            options = _options(ch)
            skip = COST_FILLER if ch in FILLERS else COST_REPEAT if ch == previous else None
            if not options and skip is None:
                options = [(ch, 0.0)]
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, out) in states.items():
            if skip is not None and cost + skip < after.get((a, b), (math.inf,))[0]:
                after[a, b] = (cost + skip, out)
            for c, more in options:
                s = ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0
                total = cost + more + costs[a][b][s]
                if total < after.get((b, s), (math.inf,))[0]:
                    after[b, s] = (total, out + c)
        states, previous = after, ch
    return min((cost + costs[a][b][0], out) for (a, b), (cost, out) in states.items())[1]


def undoubled(word: bytes, costs: list) -> bytes | None:
    """What ``restore`` gives for lower-case ASCII letters whose doubles stand alone; None for others.

    With no other choice in the lattice, whether a second letter goes depends
    on the letters beside it only.
    """
    out, at = bytearray(), 0
    for m in _REPEATED.finditer(word):
        start, end = m.span()
        if end - start > 2 or (start == at and start):
            return None
        a, x, b = (word[start - 1] - 96 if start else 0), word[start] - 96, (word[end] - 96 if end < len(word) else 0)
        drop = COST_REPEAT + costs[a][x][b] < costs[a][x][x] + costs[x][x][b]
        out += word[at : end - 1 if drop else end]
        at = end
    return bytes(out + word[at:])


def folded(text: str) -> str:
    """Letters of other scripts and with marks as the plain ones that they look like."""
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.translate(_HOMOGLYPHS))).lower()


def readings(token: str, costs: list) -> list[str]:
    """The distinct lower-case words of a token: as written, folded, and restored where it looks disguised."""
    token = _EDGE.sub("", token).lower()
    found = _LETTERS.findall(token)
    if not token.isascii():
        found += _LETTERS.findall(folded(token))
    if _DISGUISED.search(token):
        found += _LETTERS.findall(restore(token, costs))
    return [*dict.fromkeys(found)]


def _read(token: bytes, costs: list) -> bytes:
    """The words of a token, a space between two of them."""
    word = token.strip(b"\"'.,;:?!()-").lower()
    if _ASCII_LETTERS.fullmatch(word) and not token.endswith(b"!") and not token.startswith(b"("):
        restored = undoubled(word, costs)
        if restored is not None:
            return word if restored == word else word + b" " + restored
    return " ".join(readings(token.decode("utf-8", "replace"), costs)).encode()


def _read_run(run: bytes, costs: list) -> bytes:
    """The words of a run of single characters: its cheapest reading, and the words that may begin at each of them."""
    text = run.decode("utf-8", "replace")
    pieces = [_EDGE.sub("", p) for p in text.split(" ")]
    found = _LETTERS.findall(restore(text, costs, spaces=True))
    for at in range(len(pieces) - 1):
        found += _LETTERS.findall(restore("".join(pieces[at : at + _AHEAD]), costs))[:1]
    return " ".join(dict.fromkeys(found)).encode()


@dataclass
class Stemmed:
    """Words of a block of texts: the text of each, a hash of the word, and the buckets of its whole and of its first 4, 5 and 6 bytes (-1: shorter)."""

    row: np.ndarray
    key: np.ndarray
    stems: np.ndarray

    def and_(self, other: Stemmed) -> Stemmed:
        return Stemmed(*(np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("row", "key", "stems")))

    def distinct(self) -> Stemmed:
        """Each word of a text once."""
        order = np.lexsort((self.key, self.row))
        row, key = self.row[order], self.key[order]
        new = np.ones(len(order), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        return Stemmed(row[new], key[new], self.stems[order[new]])

    def best(self, evidence: np.ndarray, own: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The strongest evidence of each word, and the stem that has it. ``own``: what to use for the words of each text instead."""
        if not len(self.row):
            return np.empty(0), np.empty(0, np.int64)
        found = evidence[self.stems]
        for which in {id(o): o for o in own or []}.values():
            mine = np.array([o is which for o in own])[self.row]
            found[mine] = which[self.stems[mine]]
        found = np.where(self.stems >= 0, found, -99.0)
        at = found.argmax(1)
        every = np.arange(len(at))
        return found[every, at], self.stems[every, at]


def _packed(low: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For 1 to 6 the first bytes from each place (columns of ``at``), as one integer each."""
    out, value = [], np.zeros(len(at), np.uint64)
    for k in range(at.shape[1]):
        value = value | (low[at[:, k]].astype(np.uint64) << np.uint64(8 * k))
        out.append(value)
    return out


def _bucket(value: np.ndarray, length: int) -> np.ndarray:
    return (mixed(value + np.uint64(length * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(44)).astype(np.int64)


def stems_of(word: bytes) -> set[int]:
    """The buckets of one word, as they are counted."""
    return {int(i) for i in _stemmed(words_of([word]), np.zeros(1, np.int64)).stems.ravel() if i >= 0}


def _stemmed(w: Words, rows: np.ndarray) -> Stemmed:
    """Stems of lower-case words of three bytes and more."""
    size = w.ends - w.starts
    keep = size > 2
    start, end, size, row = w.starts[keep], w.ends[keep], size[keep], rows[keep]
    at = np.minimum(start[:, None] + np.arange(6), len(w.buffer) - 1)
    packed = _packed(w.buffer, at)
    key = mixed(word_hashes(Words(w.buffer, start, end, np.array([0, len(start)]))))
    stems = np.full((len(start), 4), -1, np.int64)
    stems[:, 0] = (key >> np.uint64(44)).astype(np.int64)
    for column, k in enumerate((4, 5, 6), start=1):
        whole = size == k
        stems[:, column] = np.where(size >= k, _bucket(packed[k - 1], k), -1)
        stems[whole, 0] = stems[whole, column]
    stems[size == 3, 0] = _bucket(packed[2], 3)[size == 3]
    return Stemmed(row, key, stems)


class Reader:
    """The words of blocks of texts under one character model.

    Words of Latin letters without doubles are taken as they stand, and without
    their marks, all at once; each other token is decoded once and remembered.
    """

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.tokens = _Recent(lambda t: _read(t, self.costs))
        self.runs = _Recent(lambda r: _read_run(r, self.costs))
        self.joins = _Recent(self._joins)

    def _joins(self, run: bytes) -> bool:
        """Whether the cheapest reading of some pieces makes the first ones a word."""
        first = len(run.split(b" ")[0].decode("utf-8", "replace"))
        found = restore(run.decode("utf-8", "replace"), self.costs, spaces=True)
        return len(found.split(" ")[0]) > first

    def read(self, texts: list[bytes | None]) -> tuple[Stemmed, Stemmed, Callable[[int], bytes]]:
        """Distinct words; words that may begin in one token and end in another, where every piece is short, and others; and the text of one of these."""
        w = words_of([t or b"" for t in texts])
        low = _LOWER[w.buffer]
        # Latin letters with marks are two bytes, 0xC3 and another.
        lead = np.append(low[:-1] == 0xC3, False)
        after = np.flatnonzero(lead) + 1
        low[after] = _SMALL_OF[low[after]]
        rows = w.rows()
        first, last = np.flatnonzero(_FIRST[low]), np.flatnonzero(_INNER[low])
        none = np.empty(0, np.int64)
        if not len(last):
            empty = Stemmed(none, none.astype(np.uint64), np.empty((0, 4), np.int64))
            return empty, empty, lambda i: b""
        # The core of each token: without marks at its edges.
        start = first[np.minimum(np.searchsorted(first, w.starts), len(first) - 1)]
        end = last[np.searchsorted(last, w.ends) - 1] + 1
        real = (start >= w.starts) & (end <= w.ends) & (end > start)
        marked = np.zeros(len(low), bool)
        marked[after] = _PLAIN_OF[low[after]] > 0
        marked[:-1] |= marked[1:] & lead[:-1]
        upto = lambda flags: np.append(0, np.cumsum(flags, dtype=np.int64))
        letters = (low >= 97) & (low <= 122)
        odd, high = upto(~(letters | marked)), upto(marked)
        twice = upto(np.append((low[1:] == low[:-1]) & letters[1:], False))
        again = upto(np.append((low[2:] == low[:-2]) & marked[2:] & marked[:-2], [False] * min(2, len(low)))[: len(low)])
        inner = np.maximum(end - 1, start)
        plain = real & (odd[end] == odd[start]) & (twice[inner] == twice[start]) & (again[np.maximum(end - 2, start)] == again[start])
        found = _stemmed(Words(low, start[plain], end[plain], none), rows[plain])
        # The same words with their marks taken off.
        both = np.flatnonzero(plain & (high[end] > high[start]))
        if len(both):
            bare = np.where(marked, _PLAIN_OF[low], low)
            keep = ~(lead & marked)
            place = upto(keep)
            found = found.and_(_stemmed(Words(bare[keep], place[start[both]], place[end[both]], none), rows[both]))

        buffer = w.buffer.tobytes()
        rest = np.flatnonzero(real & ~plain)
        entries = [*map(self.tokens.__getitem__, [buffer[a:b] for a, b in zip(w.starts[rest].tolist(), w.ends[rest].tolist(), strict=True)])]
        owners = [rows[rest]]
        # Runs of three and more single characters.
        shown = upto(_SINGLE[w.buffer])
        single = shown[w.ends] - shown[w.starts] == 1
        near = single[:-1] & single[1:] & (rows[1:] == rows[:-1])
        edges = np.diff(np.concatenate([[0], near.astype(np.int8), [0]]))
        a, b = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
        a, b = a[b - a > 1], b[b - a > 1]
        entries += [self.runs[b" ".join(buffer[w.starts[i] : w.ends[j]].split())] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        owners.append(rows[a])
        more = words_of(entries)
        found = found.and_(_stemmed(more, np.concatenate(owners)[more.rows()])).distinct()
        return found, *self._across(w, low, rows, start, real, buffer)

    def _across(self, w: Words, low: np.ndarray, rows: np.ndarray, start: np.ndarray, real: np.ndarray, buffer: bytes) -> tuple[Stemmed, Callable[[int], bytes]]:
        """Beginnings of 4 to 6 bytes that reach beyond a token, and the pieces of one of them."""
        place = np.flatnonzero(_LETTER[low])
        token = np.searchsorted(w.starts, place, side="right") - 1
        size = np.bincount(token, minlength=len(w.starts))
        tokens = np.flatnonzero(real & (size > 0) & (size < 6))
        j = np.searchsorted(place, start[tokens])
        tokens, j = tokens[(j + 3 < len(place))], j[(j + 3 < len(place))]
        spot = np.minimum(j[:, None] + np.arange(6), len(place) - 1)
        same = (rows[token[spot]] == rows[tokens][:, None]) & (j[:, None] + np.arange(6) < len(place))
        beyond = token[spot] > tokens[:, None]
        ok = (place[j] == start[tokens]) & same[:, 3] & (beyond & same).any(1)
        tokens, j, spot, same, beyond = tokens[ok], j[ok], spot[ok], same[ok], beyond[ok]
        packed = _packed(low, place[spot])
        stems = np.full((len(tokens), 4), -1, np.int64)
        for column, k in enumerate((4, 5, 6), start=1):
            stems[:, column] = np.where(same[:, k - 1] & beyond[:, k - 1], _bucket(packed[k - 1], k), -1)
        key = mixed(packed[5] ^ np.uint64(0x51ED270B))

        def pieces(i: int) -> bytes:
            t = int(tokens[i])
            to, letters = t, 0
            while to < len(size) and rows[to] == rows[t] and letters < _AHEAD:
                letters, to = letters + int(size[to]), to + 1
            return b" ".join(_EDGE_BYTES.sub(b"", p) for p in buffer[w.starts[t] : w.ends[to - 1]].split())

        return Stemmed(rows[tokens], key, stems), pieces

    def strongest(self, texts: list[bytes | None], evidence: np.ndarray, own: list[np.ndarray] | None, base: float) -> np.ndarray:
        """The ``_TOP`` strongest stems in the words of each text, filled up with the base.

        ``own``: evidence to use for the words of each text in place of
        ``evidence``. Words across tokens count where they are stronger, if the
        model reads their pieces as one word.
        """
        found, across, pieces = self.read(texts)
        values, stems = found.best(evidence, own)
        top = _top(found.row, values, stems, len(texts), base)
        spaced, beginnings = across.best(evidence, own)
        better = np.flatnonzero(spaced > top[across.row, -1]) if len(across.row) else np.empty(0, np.int64)
        better = np.array([i for i in better.tolist() if self.joins[pieces(i)]], np.int64)
        if len(better):
            row = np.append(found.row, across.row[better])
            top = _top(row, np.append(values, spaced[better]), np.append(stems, beginnings[better]), len(texts), base)
        return top


def _top(row: np.ndarray, values: np.ndarray, stems: np.ndarray, rows: int, base: float) -> np.ndarray:
    """The ``_TOP`` largest values of different stems of each row, filled up with the base."""
    out = np.full((rows, _TOP), base)
    keep = np.flatnonzero(values > base)
    order = keep[np.lexsort((stems[keep], -values[keep], row[keep]))]
    row, stems, values = row[order], stems[order], values[order]
    new = np.ones(len(order), bool)
    new[1:] = (row[1:] != row[:-1]) | (stems[1:] != stems[:-1])
    row, values = row[new], values[new]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    inside = rank < _TOP
    out[row[inside], rank[inside]] = values[inside]
    return out


class _Recent(dict):
    """What was worked out lately: when full, the older half goes, so that frequent words stay."""

    def __init__(self, work: Callable[[bytes], object]):
        super().__init__()
        self.work, self.older = work, {}

    def __missing__(self, key: bytes) -> object:
        if len(self) >= _CACHED:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        found = self[key] = self.work(key) if found is None else found
        return found


@dataclass
class Model:
    """What is learned: the character model, evidence per hashed stem, and a logistic on the strongest words."""

    key: str
    costs: np.ndarray
    evidence: np.ndarray
    base: float
    weights: np.ndarray = field(default_factory=lambda: np.zeros(_TOP + 1))


_KNOWN: dict[str, Reader] = {}
caches(_KNOWN)


def _reader(model: Model) -> Reader:
    """One reader per model for all tasks of a Python worker."""
    claim(_KNOWN)
    if model.key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[model.key] = Reader(model.costs)
    return _KNOWN[model.key]


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Sum ``rows(block int, counts binary)`` of int64 tables; the result has a fixed size."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()], axis=0)
        return pa.table({"block": table["block"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size, np.int64)
    for block, counts in rows.groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        part = np.frombuffer(counts, np.int64)
        out[block * len(part) : (block + 1) * len(part)] = part
    return out


def _blocks(counts: np.ndarray, blocks: int) -> pa.RecordBatch:
    parts = np.split(counts.astype(np.int64), blocks)
    keep = [i for i, p in enumerate(parts) if p.any()]
    return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([parts[i].tobytes() for i in keep], pa.binary())], ["block", "counts"])


def character_costs(docs: DataFrame) -> np.ndarray:
    """The character model of ``docs(text)``, counted over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), 256):
                total += count_trigrams(texts[at : at + 256])
        yield _blocks(total, SYMBOLS)

    return trigram_costs(_summed(docs.select("text").mapInArrow(count, "block int, counts binary"), SYMBOLS**3))


def _logit(p: np.ndarray | float) -> np.ndarray:
    return np.log(p / (1 - p))


def _shrunk(ones: np.ndarray, all_: np.ndarray, rate: float) -> np.ndarray:
    return _logit((ones + _PRIOR * rate) / (all_ + _PRIOR))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int) -> Model | None:
    """Learn from ``docs(id, text)`` and ``labels(id, toxic)``; None where a class has no training row."""
    spark = docs.sparkSession
    costs = character_costs(docs)
    sample = (
        labels.where("id IS NOT NULL AND toxic IS NOT NULL AND crc32(CAST(id AS STRING)) % 5 <> 0")
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(train_rows)
    )
    folder = new_folder(spark, "toxicity")
    # At most ``train_rows`` pairs of numbers: a proven size.
    rows = written(docs.join(F.broadcast(sample), "id").select("text", "toxic"), folder)
    sizes = dict(rows.groupBy("toxic").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        remove(spark, folder)
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Reader(costs), np.zeros(2 * BUCKETS, np.int64)
        for part in slices(batches, 0):
            found, across, _ = known.read(part.column(0).cast(pa.binary()).to_pylist())
            # What neighbours happen to spell counts too, so that it is no evidence where it is common.
            found = found.and_(across)
            toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            # Each stem once for a text, whichever of its words have it.
            pairs = (found.row[:, None] * BUCKETS + found.stems)[found.stems >= 0]
            row, stem = np.divmod(np.unique(pairs), BUCKETS)
            total += np.bincount(2 * stem + toxic[row], minlength=2 * BUCKETS)
        yield _blocks(total.reshape(-1), 256)

    counts = _summed(rows.mapInArrow(count, "block int, counts binary"), 2 * BUCKETS).reshape(-1, 2)
    rate = sizes[1] / (sizes[0] + sizes[1])
    base = float(_logit(rate))
    ones, all_ = counts[:, 1].astype(np.float32), counts.sum(1).astype(np.float32)

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each training row as seen by the others: its own counts are taken out."""
        known = Reader(costs)
        whole = _shrunk(ones, all_, rate)
        with np.errstate(invalid="ignore", divide="ignore"):  # of stems that no row has
            others = [_shrunk(ones - toxic, all_ - 1, rate) for toxic in (0, 1)]
        for part in slices(batches, 0):
            labels_ = part.column(1).to_pylist()
            tops = known.strongest(part.column(0).cast(pa.binary()).to_pylist(), whole, [others[t] for t in labels_], base)
            yield pa.RecordBatch.from_arrays([pa.array(labels_, pa.int32()), pa.array(tops.tolist(), pa.list_(pa.float64()))], ["toxic", "top"])

    seen = rows.select("text", F.col("toxic").cast("int")).mapInArrow(strongest, "toxic int, top array<double>").collect()
    remove(spark, folder)
    evidence = _shrunk(ones, all_, rate).astype(np.float32)
    weights = fit_logistic(np.array([r["top"] for r in seen]), np.array([r["toxic"] for r in seen], np.float64))
    return Model(folder, costs, evidence, base, weights)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 30_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col``, ``held_out``, ``score``, ``predicted`` and ``carry`` columns.

    ``held_out`` marks rows whose crc32 of the id as text is divisible by 5;
    their labels are not learned. ``score`` is from 0 to 1 and uses only the
    text; ``predicted`` is 1 from 0.5. A null, empty or wordless text gets the
    score of a document without evidence. A null id is not held out. Rows that
    repeat are all scored; of several labels of an id the largest counts, null
    labels do not. Where no label of either class is known, all scores are 0.
    An empty table gives no rows. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(carry))]
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    model = fit(base.select("id", "text"), marks, train_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _reader(model) if model else None
        for batch in slices(batches, 1):
            out = np.zeros(batch.num_rows)
            if known is not None:
                top = known.strongest(batch.column(1).cast(pa.binary()).to_pylist(), model.evidence, None, model.base)
                out = 1 / (1 + np.exp(-np.clip(top @ model.weights[:-1] + model.weights[-1], -30, 30)))
            columns = [batch.column(i) for i in range(batch.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out)], ["id", *names, "score"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "text"]
    scored = base.mapInArrow(score, ", ".join([*fields, "score double"]))
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)],
    )
