"""Secrets in texts: keyword automaton first, anchored patterns only at its hits, then checksums.

An Aho-Corasick automaton finds all keywords in one pass; a pattern is tried
only where a keyword of its kind begins. Long runs of hexadecimal digits have
no keyword; they are found by a scan for runs. Tokens that carry a checksum
are kept only where it holds.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireloom.llm.shared import bounded_batches

# Kinds in the order in which they are listed, keywords in lower case, patterns and least lengths.
BASE_KINDS = ("assign", "access", "hex")
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
    "jwt": ["eyj"],
    "pem": ["-----begin "],
}
ASSIGN_WORD = re.compile(rb"(?i:password|passwd|secret|token|api_?key)")
ASSIGN_REST = re.compile(rb"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
CHECKED_TOKEN = re.compile(rb"(?:gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
JWT_RUN = re.compile(rb"[A-Za-z0-9_-]*")
PEM = re.compile(rb"-----BEGIN ([A-Z ]*PRIVATE KEY(?: BLOCK)?)-----[ \t]*(?:\r?\n[A-Za-z][A-Za-z0-9-]*:[^\n]*)*[A-Za-z0-9+/=\s]+-----END \1-----")
MIN_VALUE, MIN_ACCESS = 12, 18
KINDS = (*BASE_KINDS, "github", "npm", "jwt", "pem")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# End of the fixed values.


def base62(number: int, width: int) -> str:
    out = ""
    while number:
        number, digit = divmod(number, 62)
        out = _DIGITS[digit] + out
    return out.rjust(width, "0")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _checked(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of the random part, in base 62."""
    return base62(zlib.crc32(match[1]), 6).encode() == match[2]


def _decodes(match: re.Match) -> bool:
    """The head is a JSON object that names an algorithm; one nested too deep to read is none."""
    try:
        head = json.loads(base64.urlsafe_b64decode(match[1] + b"=" * (-len(match[1]) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


def find_spans(text: bytes) -> list[tuple[int, int, str]]:
    """Byte spans (start, end, kind) in order of start, then kind. ``text`` is UTF-8."""
    found: list[tuple[int, int, str]] = []
    last = dict.fromkeys(KINDS, 0)
    # One character for each byte, so that the automaton's places are byte places.
    for end, (kind, size) in _automaton().iter(text.lower().decode("latin-1")):
        at = end + 1 - size
        if at < last[kind]:
            continue
        if kind == "assign":
            word = ASSIGN_WORD.match(text, at)
            m = word and ASSIGN_REST.match(text, word.end())
            keep = bool(m) and len(m[1]) >= MIN_VALUE
        elif kind == "access":
            m = ACCESS.match(text, at)
            keep = bool(m) and m.end() - at >= MIN_ACCESS
        elif kind in ("github", "npm"):
            m = CHECKED_TOKEN.match(text, at)
            keep = bool(m) and _checked(m)
        elif kind == "jwt":
            m = JWT.match(text, at)
            keep = bool(m) and _decodes(m)
            if not m:
                # Whether a token follows is the same for every head in this run of characters.
                last[kind] = JWT_RUN.match(text, at).end()
        else:
            m = PEM.match(text, at)
            keep = bool(m)
        if m:
            last[kind] = m.end()
        if keep:
            found.append((at, m.end(), kind))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte places as places of code points."""
    if not spans or text.isascii():
        return spans
    at, points, place = 0, 0, {}
    for x in sorted({x for s in spans for x in s[:2]}):
        points += len(text[at:x].decode())
        at, place[x] = x, points
    return [(place[a], place[b], k) for a, b, k in spans]


def _mask(text: bytes, spans: list[tuple[int, int, str]]) -> bytes:
    """Each stretch of overlapping spans becomes one mark that names its first kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], b"[secret:%s]" % kind.encode()]
        at = max(at, end)
    return b"".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), masked: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, ``spans``, ``carry`` columns and, if wanted, ``masked_text``.

    ``spans`` has kind, start and end (exclusive) in code points, by start and
    then by the order of ``KINDS``. Of each kind the leftmost non-overlapping
    matches are judged; those too short or of a wrong checksum are dropped.
    A null text counts as empty and has no spans; its ``masked_text`` is null.
    Null and repeated ids are allowed. An empty table gives no rows. Other
    columns are ignored. Very long texts are scanned in one piece, in time that
    grows with their length.
    """
    bounded_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(carry))]
    base = docs.select(
        F.col(text_col).alias("text"), F.col(id_col).alias("id"), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans, texts = [], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found = find_spans(text) if text else []
                texts.append(_mask(text, found) if masked and text else text)
                spans.append([{"kind": k, "start": a, "end": b} for a, b, k in _points(text, found)])
            columns = [batch.column(i) for i in range(1, batch.num_columns)] + [pa.array(spans, kind)]
            names_out = batch.schema.names[1:] + ["spans"]
            if masked:
                columns, names_out = [*columns, pa.array(texts, pa.binary()).cast(pa.string())], [*names_out, "masked_text"]
            yield pa.RecordBatch.from_arrays(columns, names_out)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields[1:]]
    out = base.mapInArrow(scan, ", ".join([*fields, f"spans {_SPANS}", *(["masked_text string"] if masked else [])]))
    return out.select(
        F.col("id").alias(id_col), "spans", *(["masked_text"] if masked else []), *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)]
    )
