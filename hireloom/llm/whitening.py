"""PCA whitening of embeddings from an exact, bit-sliced scatter matrix.

1. Components become integers. In each block of rows a dimension is shifted by its
   least value, so that it needs few bit planes, and every plane is packed across
   the rows into 64-bit words.
2. The cross-product of two dimensions is the sum over pairs of their planes of
   2**(b + c) times the number of bits set in both (AND, then popcount). The
   shifts are added back as integers, so sums and cross-products are exact.
3. Blocks add up in Spark as decimals. The scatter is centred as integers,
   n * sum(x y) - sum(x) * sum(y), and becomes floating point only then, for eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireloom.llm.shared import new_folder, remove, written

_ENTRIES = 1 << 18
_LIMBS = 1 << 30


def planes(shifted: np.ndarray, width: int) -> np.ndarray:
    """Bit planes of the columns of an unsigned matrix, as ``[column * width + bit, word]``; rows are padded with zeros."""
    rows, columns = shifted.shape
    padded = np.zeros((-(-rows // 64) * 64, columns), np.uint64)
    padded[:rows] = shifted
    bits = (padded.T[:, None, :] >> np.arange(width, dtype=np.uint64)[None, :, None]) & np.uint64(1)
    return np.ascontiguousarray(np.packbits(bits.astype(np.uint8), axis=2)).view(np.uint64).reshape(columns * width, -1)


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums and cross-products of the columns of an int64 matrix, as Python integers."""
    rows, columns = x.shape
    least = x.min(0)
    shifted = x.view(np.uint64) - least.view(np.uint64)
    width = max(1, int(shifted.max()).bit_length())
    sliced = planes(shifted, width)
    small = rows * float(2**width) ** 2 < 2**63
    weights = np.array([1 << b for b in range(width)], np.int64 if small else object)
    sums = [0] * columns
    cross = np.zeros((columns, columns), weights.dtype)
    for i in range(columns):
        for b in range(width):
            plane = sliced[i * width + b]
            both = np.bitwise_count(plane & sliced[i * width :]).sum(1, dtype=np.int64)
            cross[i, i:] += weights[b] * (both.reshape(-1, width).astype(weights.dtype) * weights).sum(1)
            sums[i] += int(weights[b]) * int(both[b])
        cross[i:, i] = cross[i, i:]
    cross = cross.tolist()
    low = [int(v) for v in least]
    total = [s + rows * m for s, m in zip(sums, low)]
    return total, [
        [cross[i][j] + low[i] * sums[j] + low[j] * sums[i] + rows * low[i] * low[j] for j in range(columns)] for i in range(columns)
    ]


def integers(vectors: np.ndarray, scale: int, offset: int) -> np.ndarray:
    """floor(scale * c) + offset as int64; values outside its range are held at its ends."""
    scaled = np.floor(vectors * float(scale))
    high = scaled >= 2.0**62
    out = np.where(high | (scaled < -(2.0**62)), 0.0, scaled).astype(np.int64)
    out[high], out[scaled < -(2.0**62)] = 2**62, -(2**62)
    return out + offset


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: exact counts, and unit eigenvectors by falling eigenvalue."""

    rows: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in double precision; whole and fractional part of the mean are taken away in turn."""
        whole = np.array([s // self.rows for s in self.sums], np.int64)
        part = np.array([s % self.rows / self.rows for s in self.sums])
        return (x - whole).astype(np.float64) - part

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return self.centred(x) @ self.vectors * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)**2 of each row, exactly; None beyond 38 digits."""
        whole = np.array([s // self.rows for s in self.sums], np.int64)
        rest = np.array([s % self.rows for s in self.sums], np.int64)
        span = max((abs(self.rows * int(v) - s) for row in (x.min(0), x.max(0)) for v, s in zip(row, self.sums)), default=0) if len(x) else 0
        if span and len(self.sums) * span**2 >= 2**63:
            found = (((x - whole).astype(object) * self.rows - rest) ** 2).sum(1).tolist()
            return [v if v < 10**38 else None for v in found]
        wide = (x - whole) * self.rows - rest
        return (wide**2).sum(1).tolist()


def fit(rows: int, sums: list[int], cross: list[list[int]], components: int) -> Whitening:
    """Eigenvectors of the covariance with divisor n, centred as integers."""
    d = len(sums)
    centred = [[rows * cross[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    # True division of integers rounds once, whatever their size.
    cov = np.array([[c / (rows * rows) for c in row] for row in centred]) if d else np.zeros((0, 0))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    trace = sum(centred[i][i] for i in range(d)) / (rows * rows) if rows else 0.0
    kept = values[order]
    # What eigh leaves of a zero is noise of the size of the largest value's last bits.
    kept = np.where(kept > 1e-13 * max(trace, 0.0), kept, 0.0)
    return Whitening(rows, tuple(sums), kept, vectors[:, order], trace)


def _blocks(x, width: int) -> Iterator:
    """Slices of a batch or matrix with a bounded number of entries, so that wide vectors need no more memory."""
    size = max(64, _ENTRIES // max(1, width))
    for at in range(0, len(x), size):
        yield x[at : at + size] if isinstance(x, np.ndarray) else x.slice(at, size)


def _matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def _slicer(width: int, scale: int, offset: int):
    """Rows to one row per entry of a task's upper triangle; sums stand at j = -1. Two limbs keep the sums in Spark exact."""

    def slice_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cross = np.zeros(width, object), np.zeros((width, width), object)
        seen = 0
        for batch in batches:
            x = integers(_matrix(batch, "v", width), scale, offset)
            for block in _blocks(x, width):
                s, c = scatter(block)
                total, cross, seen = total + np.array(s, object), cross + np.array(c, object), seen + len(block)
        if not seen:
            return
        rows = [(-1, -1, seen)] + [(i, -1, total[i]) for i in range(width)]
        rows += [(i, j, cross[i, j]) for i in range(width) for j in range(i, width)]
        i, j, v = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([int(a) // _LIMBS for a in v], pa.decimal128(38, 0)), pa.array([int(a) % _LIMBS for a in v], pa.decimal128(38, 0))],
            ["i", "j", "high", "low"],
        )

    return slice_up


_WHITE = "id long, deviation decimal(38,0), whitened array<double>"


def _whitener(model: Whitening, width: int, scale: int, offset: int):
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch, width):
                x = integers(_matrix(part, "v", width), scale, offset)
                white = model.projected(x)
                k = white.shape[1]
                flat = pa.array(white.ravel(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.deviations(x), pa.decimal128(38, 0)), lists], ["id", "deviation", "whitened"])

    return whiten


def _moments(k: int):
    """Counts, sums and scatter of whitened rows, centred on each batch's own mean before multiplying."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, inner, outer = 0, np.zeros(k), np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            y = np.nan_to_num(_matrix(batch, "whitened", k).astype(np.float64))
            mean = y.mean(0)
            n, total = n + len(y), total + y.sum(0)
            inner += (y - mean).T @ (y - mean)
            outer += len(y) * np.outer(mean, mean)
        flat = np.concatenate([[n], total, (inner + outer).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["at", "v"])

    return moments


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000
) -> DataFrame:
    """A row per vector and component: ``id_col``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Each entry c becomes the integer floor(scale * c) + offset. Every vector is
    in the fit list. Components are unit eigenvectors of the covariance (divisor
    n) by falling eigenvalue; signs are free. ``deviation`` is the exact sum of
    (n * x - S)**2 as decimal(38,0), null beyond 38 digits. ``identity_error`` is
    measured over the whitened rows.

    Vectors that are null or hold null or non-finite entries are left out, as
    are those of another length than the most frequent one (the longer of two).
    Null ids stay, and rows that repeat count and return as often as they
    occur. A component without variance has null ``whitened``, explains 0 and is
    left out of ``identity_error``. Empty tables and empty vectors give no rows.
    Other columns are ignored. The driver holds the square matrix of the
    dimensions, never rows. Three passes read the vectors.
    """
    spark = vectors.sparkSession
    good = F.expr("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(good)
    # Lengths are ranked in Spark; one row comes back.
    lengths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "width"))["width"]).first()
    width = lengths[0] or 0
    rows = rows.where(F.size("v") == width)
    folder = new_folder(spark, "whitening")
    model = _fitted(rows, width, components, scale, offset)
    k = len(model.values)
    white = written(rows.mapInArrow(_whitener(model, width, scale, offset), _WHITE), f"{folder}/white")
    error = _identity_error(white, model, k)
    explained = [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values]
    out = white.select(
        F.col("id").alias(id_col),
        F.lit(model.rows).cast("long").alias("n"),
        "deviation",
        F.posexplode("whitened").alias("at", "whitened"),
    )
    shares: Column = F.array(*[F.lit(e) for e in explained]) if explained else F.array().cast("array<double>")
    return out.select(
        id_col,
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _fitted(rows: DataFrame, width: int, components: int, scale: int, offset: int) -> Whitening:
    parts = rows.select("v").mapInArrow(_slicer(width, scale, offset), "i int, j int, high decimal(38,0), low decimal(38,0)")
    added = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    entries = {(r.i, r.j): int(r.high) * _LIMBS + int(r.low) for r in added}
    n = entries.get((-1, -1), 0)
    d = width if n else 0
    sums = [entries[i, -1] for i in range(d)]
    cross = [[entries[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]
    return fit(n, sums, cross, components)


def _identity_error(white: DataFrame, model: Whitening, k: int) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity."""
    live = model.values > 0
    if not live.any():
        return 0.0
    added = white.select("whitened").mapInArrow(_moments(k), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + k + k * k)
    for r in added:
        flat[r["at"]] = r["v"]
    mean = flat[1 : 1 + k] / flat[0]
    cov = flat[1 + k :].reshape(k, k) / flat[0] - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k))[np.ix_(live, live)].max())
