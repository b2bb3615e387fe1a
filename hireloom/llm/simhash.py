"""Near-duplicate documents by SimHash, joined through tables of pivot distances.

1. A document's fingerprint has a bit set where over half of its shingles' hashes
   have it. Documents of equal fingerprints are one node from here on.
2. The pivots are fixed reference fingerprints. A node's table holds its Hamming
   distance to every pivot, kept apart by segment of the bits; the parts of one
   pivot add up to the whole distance. By the triangle inequality no coordinate
   of two nodes differs by more than their own distance, in the whole table and
   in each segment.
3. Two nodes that differ in at most r bits have, in at least s - r of s segments,
   a coordinate difference of zero for every pivot. Nodes are dealt by the
   coordinates of each choice of s - r segments, so linked nodes meet in at least
   one bucket. A bucket of many nodes is dealt again by the bits not used yet,
   until buckets are small; nothing is left out.
4. Inside a bucket the nodes are sorted by the first coordinate. Pairs whose largest
   coordinate difference is over r are discarded, the survivors are verified on
   the fingerprints, and a bucket of many nodes gives a spanning star of each of its
   components instead of all of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireloom.llm.graph import components
from hireloom.llm.shared import bounded_batches, new_folder, remove, written
from hireloom.llm.words import mixed, words_of

_BITS = 64
_SLICE = 1 << 17
_SMALL = 16


def pivots(count: int) -> np.ndarray:
    """``count`` reference fingerprints, the same everywhere."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprints(texts: list[bytes | None], shingle: int, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each text over its word shingles, repeats included.

    A text of fewer words has its whole sequence as one shingle; one without words has fingerprint 0.
    """
    w = words_of(texts, lower=True)
    counts, lengths = w.counts, w.ends - w.starts
    # Words with one separator byte after each; the separators become spaces.
    keep = np.zeros(len(w.buffer) + 1, np.int8)
    keep[w.starts] += 1
    keep[w.ends + 1] -= 1
    buffer = w.buffer.copy()
    buffer[w.ends] = 32
    plain = buffer[np.cumsum(keep[:-1], dtype=np.int8) > 0].tobytes()
    begin = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=begin[1:])
    end = begin[1:] - 1

    sizes = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    first = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=first[1:])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = w.first[:-1][owner] + np.arange(len(owner)) - first[:-1][owner]
    last = np.minimum(at + shingle, w.first[1:][owner]) - 1
    totals = np.zeros((len(sizes), _BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(owner), _SLICE):
        part = slice(lo, lo + _SLICE)
        spans = zip(begin[at[part]].tolist(), end[last[part]].tolist(), strict=True)
        hashes = np.fromiter((digest(plain[a:b], seed) for a, b in spans), np.uint64, len(at[part]))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows, where = np.unique(owner[part], return_index=True)
        totals[rows] += np.add.reduceat(bits, where, axis=0, dtype=np.int64)
    set_bits = (2 * totals > sizes[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def distances(nodes: np.ndarray, refs: np.ndarray, mask: int = 2**64 - 1) -> np.ndarray:
    """A row of pivot distances for each node, over the bits of ``mask``."""
    return np.bitwise_count((nodes[:, None] ^ refs[None, :]) & np.uint64(mask))


def split(bits: list[int], count: int) -> list[int]:
    """Masks of ``count`` segments that cut the given bits into runs of about the same size."""
    cuts = [len(bits) * i // count for i in range(count + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def _segments(nodes: int, bits: int, radius: int, expected: int = 64) -> int:
    """The fewest segments whose chosen bits tell ``nodes`` random fingerprints apart, but for ``expected`` of them."""
    for count in range(radius + 1, bits):
        if nodes / 2.0 ** (bits * (count - radius) / count) <= expected:
            return count
    return bits


_KEYED = "key long, fp long, rest long"


def _dealer(refs: np.ndarray, radius: int, count: int):
    """Rows ``(key, fp, rest)`` to one row per choice of segments of the bits in ``rest``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, rest = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            for mask in np.unique(rest).tolist():
                mine = np.flatnonzero(rest == np.uint64(mask))
                bits = [b for b in range(_BITS) if mask >> b & 1]
                parts = split(bits, min(count, len(bits)))
                for lo in range(0, len(mine), 1 << 14):
                    some = mine[lo : lo + (1 << 14)]
                    codes = [_code(distances(nodes[some], refs, part)) for part in parts]
                    for n, chosen in enumerate(combinations(range(len(parts)), max(1, len(parts) - radius))):
                        key, used = mixed(keys[some] + np.uint64(n + 1)), 0
                        for i in chosen:
                            key, used = mixed(key * np.uint64(0x9E3779B97F4A7C15) + codes[i]), used | parts[i]
                        left = np.full(len(some), mask & ~used, np.uint64)
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, nodes[some], left)], ["key", "fp", "rest"])

    return deal


def _code(table: np.ndarray) -> np.ndarray:
    """Equal rows of coordinates have equal codes."""
    code = np.zeros(len(table), np.uint64)
    for column in table.T:
        code = mixed(code + column + np.uint64(1))
    return code


def _near(table: np.ndarray, nodes: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (x, y) are linked: discarded by coordinates, a few pivots at a time, then verified."""
    alive = np.arange(len(x))
    for lo in range(0, table.shape[1], 8):
        a, b = table[x[alive], lo : lo + 8], table[y[alive], lo : lo + 8]
        alive = alive[(np.abs(a - b) <= radius).all(1)]
        if not len(alive):
            return alive
    return alive[np.bitwise_count(nodes[x[alive]] ^ nodes[y[alive]]) <= radius]


def bucket_links(keys: np.ndarray, nodes: np.ndarray, refs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes of one key: all of a small bucket, a star of each component of a larger one."""
    table = distances(nodes, refs).astype(np.int8)
    order = np.lexsort((table[:, 0], keys))
    keys, nodes, table = keys[order], nodes[order], table[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    sizes = np.diff(np.append(starts, len(keys)))
    ends = np.repeat(starts + sizes, sizes)
    left, right = [], []
    first = table[:, 0]
    alive = np.flatnonzero(np.repeat(sizes, sizes) <= _SMALL)
    for off in range(1, _SMALL):
        alive = alive[alive + off < ends[alive]]
        alive = alive[first[alive + off] - first[alive] <= radius]
        if not len(alive):
            break
        hit = alive[_near(table, nodes, alive, alive + off, radius)]
        left.append(nodes[hit])
        right.append(nodes[hit + off])
    for lo, size in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        for head, tail in _stars(table[lo : lo + size], nodes[lo : lo + size], radius):
            left.append(np.full(len(tail), nodes[lo + head]))
            right.append(nodes[lo + tail])
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _stars(table: np.ndarray, nodes: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Walk the components of a bucket that is sorted by its first coordinate; each node meets only those not reached yet."""
    unseen = np.arange(len(nodes))
    first = table[:, 0]
    while len(unseen) > 1:
        head, unseen = int(unseen[0]), unseen[1:]
        frontier = [head]
        while frontier and len(unseen):
            x = frontier.pop()
            lo, hi = np.searchsorted(first[unseen], (first[x] - radius, first[x] + radius + 1))
            near = unseen[lo:hi]
            found = _near(table, nodes, np.full(len(near), x), near, radius)
            if len(found):
                yield head, near[found]
                frontier += near[found].tolist()
                unseen = np.delete(unseen, lo + found)


def _linker(refs: np.ndarray, radius: int):
    """Links of rows ``(key, fp)`` that come sorted by key; a bucket may go on in the next batch."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = nodes = np.empty(0, np.uint64)

        def found(upto: int) -> pa.RecordBatch:
            a, b = bucket_links(keys[:upto], nodes[:upto], refs, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
            keys, nodes = np.concatenate([keys, k]), np.concatenate([nodes, f])
            if len(keys) >= 1 << 15:
                upto = int(np.flatnonzero(keys == keys[-1])[0])
                yield found(upto)
                keys, nodes = keys[upto:], nodes[upto:]
        yield found(len(keys))

    return link


def hamming_links(nodes: DataFrame, folder: str, radius: int = 4, pivot_count: int = 32, bucket_rows: int = 2048, segments: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that join every component of the distinct fingerprints ``fp`` at ``radius`` bits or fewer.

    Small buckets give all of their links, larger ones a star of each
    component. ``segments`` (more than ``radius``) is worked out from the
    number of nodes where it is None; it decides on the cost, not the result.
    """
    spark, refs = nodes.sparkSession, pivots(pivot_count)
    bucket_rows = max(bucket_rows, 2**radius)  # as many as can lie in the last few bits, where nothing is left to deal by
    count = segments or max(radius + 2, _segments(nodes.count(), _BITS, radius))
    rows = nodes.selectExpr("0L AS key", "fp", "-1L AS rest")
    found = None
    for turn in range(_BITS):
        dealt = written(rows.mapInArrow(_dealer(refs, radius, count), _KEYED), f"{folder}/dealt{turn}")
        # A bucket with few bits left holds few distinct nodes, so the turns end.
        hot = written(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("key"), f"{folder}/hot{turn}")
        any_hot = not hot.isEmpty()
        cold = dealt.join(hot, "key", "left_anti") if any_hot else dealt
        linked = cold.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_linker(refs, radius), "a long, b long")
        linked = written(linked, f"{folder}/links{turn}")
        found = linked if found is None else found.union(linked)
        if not any_hot:
            break
        rows = dealt.join(hot, "key", "left_semi")
        count = radius + 2
    for n in range(turn + 1):
        remove(spark, f"{folder}/hot{n}")
        remove(spark, f"{folder}/dealt{n}")
    return found.distinct()


def _printer(shingle: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = fingerprints(part.column(1).cast(pa.binary()).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return prints


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, pivot_count: int = 32, bucket_rows: int = 2048, segments: int | None = None
) -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (16 lower-case hex digits), ``component_id``.

    Shingles are ``shingle`` words (A-Z lower-cased), repeats included; their
    hash is XXH64 of the words joined by spaces, seed 42. Linked are documents
    whose fingerprints differ in at most ``radius`` bits; ``component_id`` is
    the smallest id reachable, itself included.

    A text of fewer words is one shingle. A null or empty text, or one without
    words, has fingerprint zero and is linked like any other. A row with a null
    id takes no part in links and has a null component. Rows of one id with
    different texts are one document for the links; all rows are returned. An
    empty table gives no rows. Very long texts are hashed in slices. Other
    columns are ignored. Tables of the steps are written to the shared folder;
    the returned frame still reads two of them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = new_folder(spark, "simhash")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(base.mapInArrow(_printer(shingle), "id long, fp long"), f"{folder}/rows")
    named = rows.where("id IS NOT NULL")
    nodes = written(named.groupBy("fp").agg(F.min("id").alias("least")), f"{folder}/nodes")
    links = hamming_links(nodes.select("fp"), folder, radius, pivot_count, bucket_rows, segments)
    several = named.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top")
    twins = named.join(several.select("id", "a"), "id").select("a", F.col("fp").alias("b"))
    joined = components(links.union(twins), f"{folder}/steps")
    groups = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    least = groups.groupBy("group").agg(F.min("least").alias("component_id"))
    labels = written(groups.join(least, "group").select("fp", "component_id"), f"{folder}/labels")
    for name in ("nodes", "steps"):
        remove(spark, f"{folder}/{name}")
    out = rows.join(labels, "fp", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
