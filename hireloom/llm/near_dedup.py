"""Near-duplicate documents by one-permutation MinHash.

1. Each document becomes the set of hashes of its word shingles. Documents of
   equal sets are one class, represented by the smallest id.
2. One permutation: a shingle's hash gives its bin and its value, a bin keeps
   its least value, and empty bins borrow by optimal densification: they probe
   other bins in an order that depends only on the bin, until one is filled.
3. Bins are cut into bands; documents that share a band share a bucket. Each
   bucket links its members to its smallest id only (a star), so the number of
   candidates is bounded by the number of bucket entries.
4. Candidates are confirmed on the full sets, and confirmed links joined to
   components.
5. A star says nothing of two members that both miss its centre. Where a bucket
   still holds several components, its members go to an exact join: sets of the
   wanted similarity share one of their rarest shingles (prefix filter, with
   bounds by size and position), and only pairs of different components are
   confirmed. Thus no candidate pair of any bucket is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireloom.llm.graph import components
from hireloom.llm.shared import bounded_batches, claim, new_folder, remove, slices, written
from hireloom.llm.words import mixed, window_hashes, word_hashes, words_of

ROWS, BANDS = 6, 56
_EMPTY = np.uint64(2**64 - 1)


def shingle_sets(texts: list[bytes | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text's begin.

    A text of fewer words than ``shingle`` has its whole sequence as one; one without words has none.
    """
    w = words_of(texts, lower=True)
    hashes, counts = word_hashes(w), w.counts
    wide = window_hashes(hashes, shingle)
    rows = w.rows()
    at = np.arange(len(wide))
    at = at[at + shingle <= w.first[1:][rows[at]]] if len(at) else at
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    extra = [window_hashes(hashes[w.first[r] : w.first[r + 1]], int(counts[r]))[0] for r in short]
    values = np.concatenate([wide[at], np.array(extra, np.uint64)])
    owner = np.concatenate([rows[at], short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


@lru_cache(maxsize=4)
def _probes(bins: int) -> np.ndarray:
    """For every bin the other bins in the order in which it probes them, the same for all documents."""
    keys = mixed(np.arange(bins * bins, dtype=np.uint64) + np.uint64(77)).reshape(bins, bins)
    return np.argsort(keys, axis=1).astype(np.int32)


def signatures(values: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signatures, a row for each text; texts without shingles keep empty bins."""
    n = len(first) - 1
    out = np.full((n, bins), _EMPTY, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(first))
    spread = mixed(values + np.uint64(0x51ED270B))
    slot = ((spread >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out.reshape(-1), owner * bins + slot, mixed(spread))
    probes = _probes(bins)
    filled = out != _EMPTY
    for r in np.flatnonzero(filled.any(1) & ~filled.all(1)):
        have = filled[r]
        gaps = np.flatnonzero(~have)
        order = probes[gaps]
        out[r, gaps] = out[r, order[np.arange(len(gaps)), have[order].argmax(1)]]
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket of each band, for each row of signatures."""
    n, bins = signature.shape
    parts = signature.reshape(n, bins // rows, rows)
    h = np.broadcast_to(mixed(np.arange(bins // rows, dtype=np.uint64) + np.uint64(1)), parts.shape[:2])
    for i in range(rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return h.view(np.int64)


_SKETCH = "id long, n_shingles long, digest binary, buckets array<long>"


def _sketcher(shingle: int, rows: int, band_count: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for part in slices(batches, 1):
            values, first = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), shingle)
            found = bands(signatures(values, first, rows * band_count), rows)
            sizes = np.diff(first)
            digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:], strict=True)]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, band_count, 0))]), pa.int32()), pa.array(found[sizes > 0].ravel(), pa.int64())
            )
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], ["id", "n_shingles", "digest", "buckets"])

    return sketch


def _similar(threshold: int):
    """Whether two sets, packed as sorted 64-bit values, reach ``threshold`` per cent."""

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.zeros(len(left), bool)
        for i, (x, y) in enumerate(zip(left, right, strict=True)):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
                continue
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            out[i] = 100 * both >= threshold * (len(a) + len(b) - both)
        return pd.Series(out)

    return similar


def _packer(shingle: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for part in slices(batches, 1):
            values, first = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), shingle)
            packed = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["id", "items"])

    return pack


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of ``pairs(a, b)`` those whose sets reach the threshold."""
    left, right = (sets.select(F.col("id").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.where(_similar(threshold)("items_a", "items_b")).select("a", "b")


def _rest_pairs(sets: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Pairs of different components among ``members(id, component)`` that may reach the threshold."""

    @F.pandas_udf("array<long>")
    def unpacked(items: pd.Series) -> pd.Series:
        return items.map(lambda x: np.frombuffer(x, np.int64))

    # Rows of one id with different texts are different sets.
    items = sets.join(members, "id").select("id", "component", F.xxhash64("items").alias("part"), F.explode(unpacked("items")).alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("often"))
    # Rarest first, each set alone; sets are bounded by the words of one document.
    ranked = (
        items.join(often, "item")
        .groupBy("id", "part", "component")
        .agg(F.sort_array(F.collect_list(F.struct("often", "item"))).alias("s"))
        .select("id", "component", F.size("s").alias("n"), F.posexplode("s").alias("at", "x"))
        .where(F.col("x.often") > 1)
        .where(F.expr(f"at < n - ceil({threshold} * n / 100.0) + 1"))
        .select("id", "component", "n", "at", F.col("x.item").alias("item"))
    )
    a, b = ranked.alias("a"), ranked.alias("b")
    return a.join(
        b,
        F.expr(
            "a.item = b.item AND a.id < b.id AND a.component <> b.component"
            f" AND 100 * least(a.n, b.n) >= {threshold} * greatest(a.n, b.n)"
            f" AND least(a.n - a.at, b.n - b.at) * {100 + threshold}D >= {threshold}D * (a.n + b.n)"
        ),
    ).selectExpr("a.id AS a", "b.id AS b").distinct()


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 80, rows: int = ROWS, band_count: int = BANDS
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    Linked are documents whose sets of distinct ``shingle``-word sequences (A-Z
    lower-cased) have 100 * intersection >= ``threshold`` * union. With the
    default bands a pair at 0.8 shares no bucket with a chance of 4e-8.
    ``component_id`` is the smallest id reachable, ``kept`` marks it.

    A null or empty text, or one without words, has no shingles, is linked with
    nothing and is its own component. A row with a null id takes no part in
    links and is returned with a null component and ``kept`` true. Rows of the
    same id count as one document per text; all are returned. An empty table
    gives no rows. Other columns are ignored. The tables of the steps are
    written to the shared folder; the returned frame still reads two of them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = new_folder(spark, "near")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = written(base.mapInArrow(_sketcher(shingle, rows, band_count), _SKETCH), f"{folder}/sketches")
    full = sketches.where("id IS NOT NULL AND n_shingles > 0")
    reps = full.groupBy("digest").agg(F.min("id").alias("id"))
    buckets = full.join(reps, ["digest", "id"]).select("id", F.explode("buckets").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("top")).where("a < top")
    shared = written(buckets.join(heads.select("bucket", "a"), "bucket").select("bucket", "a", F.col("id").alias("b")), f"{folder}/shared")
    pairs = shared.where("a < b").select("a", "b").distinct()
    wanted = shared.select(F.col("b").alias("id")).distinct()
    sets = written(base.join(wanted, "id", "left_semi").dropDuplicates(["id", "text"]).mapInArrow(_packer(shingle), "id long, items binary"), f"{folder}/sets")
    star = written(_confirmed(pairs, sets, threshold), f"{folder}/star")
    first = written(components(star, f"{folder}/first"), f"{folder}/joined")

    labelled = shared.join(first.withColumnRenamed("node", "b"), "b", "left").select("bucket", "b", F.coalesce("component", "b").alias("component"))
    mixed_buckets = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    rest = written(labelled.join(mixed_buckets, "bucket", "left_semi").select(F.col("b").alias("id"), "component").distinct(), f"{folder}/rest")
    more = _confirmed(_rest_pairs(sets, rest, threshold), sets, threshold)
    edges = star.union(more)
    # Rows of one id with different texts are one document for the links.
    twins = full.join(reps.withColumnRenamed("id", "rep"), "digest").select(F.col("rep").alias("a"), F.col("id").alias("b")).where("a < b")
    labels = written(components(edges.union(twins), f"{folder}/second"), f"{folder}/labels")
    for name in ("shared", "sets", "star", "first", "joined", "rest", "second"):
        remove(spark, f"{folder}/{name}")
    out = sketches.select("id", "n_shingles").join(labels.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    )
