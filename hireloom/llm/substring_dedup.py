"""Removal of passages that an earlier document already holds.

Every window of ``window`` consecutive words gets a Rabin-Karp hash. The hashes
are counted in Spark by hash range; windows whose words start in a document
with a smaller id merge into maximal removal intervals.

What is shuffled: the texts once, by ranges of the id (chunks), and for each
chunk every distinct window hash once (7 bytes beside its range, 64 bits in
all from 256 ranges on). A passage that a third of all documents share is sent
once by each chunk. As chunks are ranges of the id, the earlier chunk holds
the smaller ids, so no id travels with a hash, and the answer is one bit for
each hash sent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hireloom.llm.shared import bounded_batches, claim
from hireloom.llm.words import row_windows, word_hashes, words_of

_LAST = np.iinfo(np.int64).max
_BYTES = 7


def _ordered(table: pa.Table) -> tuple[np.ndarray, list, np.ndarray]:
    """Ids (null: largest), texts as bytes and the order of the rows by id, then text."""
    ids = table["id"].combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
    texts = table["text"].cast(pa.binary()).to_pylist()
    order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or b"")), np.int64)
    return ids[order], [texts[i] for i in order], order


class _Chunk:
    """The windows of a chunk's documents, the same each time it is read."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        self.ids, self.texts, self.order = _ordered(table)
        self.words = words_of(self.texts)
        self.at, hashes = row_windows(self.words, word_hashes(self.words), window)
        self.hashes, first, self.entry = np.unique(hashes, return_index=True, return_inverse=True)
        rows = np.searchsorted(self.words.first, self.at, side="right") - 1
        self.window_ids = self.ids[rows]
        self.first_ids = self.window_ids[first]
        # Hashes are sorted, so ranges of them are slices.
        edges = [-(-(b << 64) // buckets) for b in range(1, buckets)]
        inner = np.searchsorted(self.hashes, np.array(edges, np.uint64)) if edges else []
        self.edges = np.concatenate([[0], inner, [len(self.hashes)]]).astype(np.int64)

    def packed(self) -> np.ndarray:
        """The low bytes of each hash."""
        return self.hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES]


_HASHES = "bucket int, chunk int, hashes binary"
_MASKS = "chunk int, bucket int, mask binary"


def _send(table: pa.Table, window: int, buckets: int) -> pa.Table:
    claim()
    c = _Chunk(table, window, buckets)
    packed, chunk = c.packed(), table["chunk"][0].as_py()
    full = np.flatnonzero(np.diff(c.edges))
    blobs = [packed[c.edges[b] : c.edges[b + 1]].tobytes() for b in full]
    return pa.table(
        {
            "bucket": pa.array(full, pa.int32()),
            "chunk": pa.array(np.full(len(full), chunk), pa.int32()),
            "hashes": pa.array(blobs, pa.binary()),
        }
    )


def _count(table: pa.Table) -> pa.Table:
    """For each chunk's hashes of one range, a bit that says whether an earlier chunk holds it too."""
    blobs = table["hashes"].to_pylist()
    chunks = table["chunk"].to_numpy()
    sizes = np.array([len(b) // _BYTES for b in blobs])
    raw = np.zeros((sizes.sum(), 8), np.uint8)
    raw[:, :_BYTES] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, _BYTES)
    hashes, owner = raw.view("<u8").ravel(), np.repeat(chunks, sizes)
    order = np.lexsort((owner, hashes))
    later = np.zeros(len(order), bool)
    later[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
    cuts = np.cumsum(sizes)[:-1]
    masks = [np.packbits(m).tobytes() if m.any() else b"" for m in np.split(later, cuts)]
    keep = [i for i, m in enumerate(masks) if m]
    return pa.table(
        {
            "chunk": pa.array(chunks[keep], pa.int32()),
            "bucket": pa.array([table["bucket"][0].as_py()] * len(keep), pa.int32()),
            "mask": pa.array([masks[i] for i in keep], pa.binary()),
        }
    )


def _cut(docs: pa.Table, masks: pa.Table, window: int, buckets: int, carried: list[str], schema: pa.Schema) -> pa.Table:
    claim()
    if not docs.num_rows:
        return schema.empty_table()
    c = _Chunk(docs, window, buckets)
    earlier = np.zeros(len(c.hashes), bool)
    for bucket, mask in zip(masks["bucket"].to_pylist(), masks["mask"].to_pylist(), strict=True):
        low, high = c.edges[bucket], c.edges[bucket + 1]
        earlier[low:high] = np.unpackbits(np.frombuffer(mask, np.uint8), count=high - low).astype(bool)
    gone = earlier[c.entry] | (c.window_ids > c.first_ids[c.entry])
    n = len(c.words.starts)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, c.at[gone], 1)
    np.add.at(cover, c.at[gone] + window, -1)
    removed = np.cumsum(cover[:n]) > 0
    return _result(c, removed, docs, carried, schema)


def _result(c: _Chunk, removed: np.ndarray, docs: pa.Table, carried: list[str], schema: pa.Schema) -> pa.Table:
    w, n = c.words, len(removed)
    # Kept words and the one byte behind each, which becomes a space.
    delta = np.zeros(len(w.buffer) + 1, np.int8)
    delta[w.starts[~removed]] += 1
    delta[w.ends[~removed] + 1] -= 1
    keep = np.cumsum(delta[:-1], dtype=np.int8) > 0
    bytes_out = w.buffer.copy()
    bytes_out[w.ends] = 32
    sizes = np.concatenate([[0], np.cumsum(np.where(removed, 0, w.ends - w.starts + 1))])
    out, edges = bytes_out[keep].tobytes(), sizes[w.first]
    texts = [out[a : max(a, b - 1)] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    # Maximal intervals of removed words, [first, last] by the place in the document.
    rows = w.rows()
    starts = np.flatnonzero(removed & np.concatenate([[True], ~removed[:-1] | (rows[1:] != rows[:-1])])) if n else np.empty(0, int)
    ends = np.flatnonzero(removed & np.concatenate([~removed[1:] | (rows[1:] != rows[:-1]), [True]])) if n else np.empty(0, int)
    of = np.searchsorted(starts, w.first)
    spans = pa.StructArray.from_arrays(
        [pa.array(starts - w.first[rows[starts]], pa.int64()), pa.array(ends - w.first[rows[ends]], pa.int64())],
        ["first", "last"],
    )
    total = np.concatenate([[0], np.cumsum(removed)])
    columns = {
        "n_words": pa.array(w.counts, pa.int64()),
        "n_removed": pa.array(total[w.first[1:]] - total[w.first[:-1]], pa.int64()),
        "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
        "removed": pa.ListArray.from_arrays(pa.array(of, pa.int32()), spans),
    }
    taken = docs.select(["id", *carried]).take(pa.array(c.order))
    for name in taken.column_names:
        columns[name] = taken[name]
    return pa.table([columns[f.name] for f in schema], names=schema.names).cast(schema)


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 13,
    carry: tuple[str, ...] = (),
    chunk_bytes: int = 4 << 20,
    bucket_windows: int = 1 << 20,
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_removed``, ``kept_text``, ``removed`` and ``carry``.

    ``removed`` lists the maximal intervals of removed words; ``kept_text`` is
    what is left, joined by single spaces. A window counts as repeated where
    its words also start in a row with a smaller id, so within one document
    and among rows of equal id nothing is removed.

    A null or empty text has no words and stays, with an empty ``kept_text``.
    A null id counts as larger than all others. Rows that repeat are all
    returned. An empty table gives no rows. Columns not named are ignored.
    ``chunk_bytes`` and ``bucket_windows`` size the work of a task.
    """
    bounded_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(carry))]
    base = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
        *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)],
    )
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, -(-total // chunk_bytes)), max(1, -(-total // (6 * bucket_windows)))
    shares = [i / chunks for i in range(1, chunks)]
    cuts = np.array(base.approxQuantile("id", shares, 0.2 / chunks) if shares else [], np.float64)

    @F.pandas_udf("int")
    def chunk_of(ids: pd.Series) -> pd.Series:
        known = ids.astype("float64")
        return pd.Series(np.where(known.isna(), len(cuts), np.searchsorted(cuts, known, side="right")))

    keyed = base.withColumn("chunk", chunk_of("id"))

    def send(rows: pa.Table) -> pa.Table:
        return _send(rows, window, buckets)

    hashes = keyed.groupBy("chunk").applyInArrow(send, _HASHES)
    masks = hashes.groupBy("bucket").applyInArrow(_count, _MASKS)
    kinds = dict(zip(names, [base.schema[n].dataType for n in names], strict=True))
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
         T.StructField("kept_text", T.StringType()),
         T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
         *[T.StructField(n, k) for n, k in kinds.items()]]
    )
    arrow = to_arrow_schema(schema)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        return _cut(left, right, window, buckets, names, arrow)

    out = keyed.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(cut, schema)
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_removed", "kept_text", "removed",
        *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)],
    )
