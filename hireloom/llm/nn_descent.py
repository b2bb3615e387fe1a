"""Approximate nearest neighbours by inner product: a neighbour graph by NN-descent, queries by greedy search on it.

Nodes get one more component that makes all lengths equal and queries get 0
there, so that the nearest by distance are the largest by inner product. Each
vector is kept as 16-bit numbers with a scale of its own, so a long one takes
nothing from the others. First neighbours come from leaves of random projection trees.
Each round then joins, in Spark, the neighbours of every node (forward and a
bounded sample of reverse ones) with their codes, compares neighbours of one
node with each other and sends every node the better ones found, until few
list entries change. A query starts at its own node and at common entries
(the longest vectors and a sample) and repeatedly expands its best unexpanded
candidates, all queries in one join per step, until none is left. All last
candidates are scored on the original vectors. Equal vectors share one node,
so copies cost nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hireloom.llm.shared import bounded_batches, new_folder, remove, slices, written

_LISTS = "id long, ids binary, sims binary"
_OFFERS = "bucket int, owners binary, ids binary, sims binary"
_PRIME = 2_147_483_647
_LOWEST = np.float32(-np.inf)


def _floats(raw: np.ndarray) -> np.ndarray:
    """Codes as rows of floats: the components, last the one that makes lengths equal."""
    if not len(raw):
        return np.zeros((0, 1), np.float32)
    head = raw[:, :4].copy().view(np.float32)
    out = np.empty((len(raw), raw.shape[1] - 3), np.float32)
    np.multiply(raw[:, 4:], head[:, :1], out=out[:, :-1])
    out[:, -1] = head[:, 1]
    return out


def _decoded(values: list[bytes]) -> np.ndarray:
    return _floats(np.frombuffer(b"".join(values), np.int16).reshape(len(values), -1)) if values else _floats([])


def _raw(column: pa.ChunkedArray) -> np.ndarray:
    """Codes as 16-bit numbers, a row each, where Arrow holds them; only several chunks are copied."""
    parts = []
    for chunk in column.chunks:
        if len(chunk):
            kind = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
            ends = np.frombuffer(chunk.buffers()[1], kind)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(chunk), -1).view(np.int16))
    if not parts:
        return np.zeros((0, 4), np.int16)
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return _floats(_raw(column))


def _halves(x: np.ndarray) -> np.ndarray:
    """Half the squared length of each row: x.y - h(x) - h(y) is -|x - y|^2 / 2."""
    return (x * x).sum(-1) / 2


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Packed lists end to end, and the row of each value."""
    values = column.to_pylist()
    size = np.array([len(v) for v in values], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(values), kind), np.repeat(np.arange(len(values)), size)


def _best_lists(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar distinct ids of each owner, best first: owners, ids, sims.

    Long input goes in parts by owner: sorting holds several copies of what it sorts.
    """
    parts = -(-len(owner) // most)
    if parts < 2:
        return _best_sorted(owner, ids, sims, k)
    part = (owner % parts).astype(np.int32)
    found = []
    for p in range(parts):
        mine = np.flatnonzero(part == p)
        found.append(_best_sorted(owner[mine], ids[mine], sims[mine], k))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _best_sorted(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, owner))
    owner, ids, sims = owner[order], ids[order], sims[order]
    new = np.ones(len(ids), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, sims = owner[new], ids[new], sims[new]
    order = np.lexsort((ids, -sims, owner))
    owner, ids, sims = owner[order], ids[order], sims[order]
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    keep = rank < k
    return owner[keep], ids[keep], sims[keep]


def _list_table(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> pa.Table:
    """Rows of ``_LISTS`` from values of which those of an owner lie together."""
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    cuts = np.append(start, len(owner))
    nodes = owner[start]
    ids, sims = ids.astype(np.int64), sims.astype(np.float32)
    return pa.table(
        {
            "id": pa.array(nodes, pa.int64()),
            "ids": pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            "sims": pa.array([sims[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        }
    )


def _bucket_of(column: str, buckets: int) -> F.Column:
    """Nodes are dealt to tasks by a hash of their id, here and in ``_buckets`` the same."""
    return F.pmod(F.pmod(F.pmod(F.col(column), F.lit(_PRIME)) * 40_503, F.lit(_PRIME)), F.lit(buckets)).cast("int")


def _buckets(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ids % _PRIME * 40_503 % _PRIME % buckets


def _offer_table(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, buckets: int) -> pa.Table:
    """Candidates of many nodes, packed to one row for each task that holds some of these nodes."""
    place = _buckets(owner, buckets)
    order = np.argsort(place, kind="stable")
    place, owner, ids, sims = place[order], owner[order], ids[order].astype(np.int64), sims[order].astype(np.float32)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.empty(0, np.int64)
    cuts = [*zip(start, np.append(start, len(place))[1:], strict=True)]
    packed = lambda x: pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary())
    return pa.table({"bucket": pa.array(place[start], pa.int32()), "owners": packed(owner), "ids": packed(ids), "sims": packed(sims)})


class Trees:
    """Random projection trees over a bounded sample: planes by heap place, and the leaf of any vector."""

    def __init__(self, sample: np.ndarray, leaf: int, count: int, seed: int = 7):
        self.trees = []
        rng = np.random.default_rng(seed)
        for _ in range(count):
            planes: dict[int, tuple[np.ndarray, float]] = {}
            stack = [(1, np.arange(len(sample)))]
            while stack:
                place, rows = stack.pop()
                if len(rows) <= leaf or place >= 1 << 40:
                    continue
                a, b = rng.choice(rows, 2, replace=False)
                plane = sample[a] - sample[b]
                side = sample[rows] @ plane
                middle = float(np.median(side))
                left = side <= middle
                if left.all():
                    continue
                planes[place] = (plane, middle)
                stack += [(2 * place, rows[left]), (2 * place + 1, rows[~left])]
            self.trees.append(planes)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The heap place of each vector's leaf in each tree."""
        out = np.ones((len(x), len(self.trees)), np.int64)
        for t, planes in enumerate(self.trees):
            stack = [(1, np.arange(len(x)))]
            while stack:
                place, rows = stack.pop()
                if place not in planes or not len(rows):
                    out[rows, t] = place
                    continue
                plane, middle = planes[place]
                left = x[rows] @ plane <= middle
                stack += [(2 * place, rows[left]), (2 * place + 1, rows[~left])]
        return out


def _coded(vectors: DataFrame) -> DataFrame:
    """``id``, ``code``, ``length`` of vectors(id, v), as parts of the longest.

    A code has the scale of its vector, one more component, and the others as
    multiples of the scale. The component that makes all lengths 1 is sqrt(1 - |x|^2); 1 less
    that is kept instead: differences stay, and short vectors keep small values.
    """
    norms = vectors.select(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("n"), F.size("v").alias("w"))
    longest, width = norms.agg(F.max("n"), F.max("w")).first()
    longest, width = longest or 1.0, width or 0

    def code(batches):
        for batch in batches:
            rows, lengths = [], []
            for v in batch.column(1).to_pylist():
                x = np.zeros(width)
                x[: len(v)] = v
                x /= longest
                square = min(1.0, float(x @ x))
                scale = np.float32(max(np.abs(x).max() / 32767, 1e-37))
                more = np.float32(square / (1 + np.sqrt(1 - square)))
                rows.append(np.array([scale, more], np.float32).tobytes() + np.clip(np.round(x / scale), -32767, 32767).astype(np.int16).tobytes())
                lengths.append(np.sqrt(square))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array(lengths, pa.float64())], ["id", "code", "length"])

    return vectors.select("id", "v").mapInArrow(code, "id long, code binary, length double")


def _first_offers(nodes: DataFrame, trees: Trees, block: int, k: int, buckets: int) -> DataFrame:
    def place(batches):
        for batch in batches:
            found = trees.leaves(_codes(pa.chunked_array([batch.column("code")])))
            for t in range(found.shape[1]):
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("code"), pa.array(np.full(len(found), t), pa.int32()), pa.array(found[:, t])], ["id", "code", "tree", "leaf"])

    placed = nodes.select("id", "code").mapInArrow(place, "id long, code binary, tree int, leaf long")
    # A leaf that many near vectors share is cut by a hash into parts of bounded size, in each tree by another one.
    sizes = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (4 * block)).alias("parts"))
    dealt = placed.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")))

    def compare(table: pa.Table) -> pa.Table:
        ids, x = table["id"].to_numpy(), _codes(table["code"])
        keep = min(k, len(ids) - 1)
        if keep < 1:
            return _offer_table(*[np.empty(0, np.int64)] * 3, buckets)
        owners, others, sims, half = [], [], [], _halves(x)
        for at in range(0, len(ids), 512):
            s = x[at : at + 512] @ x.T - half - half[at : at + 512, None]
            rows = np.arange(len(s))
            s[rows, at + rows] = _LOWEST
            top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            owners.append(np.repeat(ids[at + rows], keep))
            others.append(ids[top].ravel())
            sims.append(np.take_along_axis(s, top, 1).ravel())
        return _offer_table(*map(np.concatenate, (owners, others, sims)), buckets)

    return dealt.select("tree", "leaf", "part", "id", "code").groupBy("tree", "leaf", "part").applyInArrow(compare, _OFFERS)


def _offered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(_flat(table[n], kind)[0] for n, kind in (("owners", np.int64), ("ids", np.int64), ("sims", np.float32)))


def _merged(offers: DataFrame, k: int) -> DataFrame:
    """One list per node, the k best of all its offers; some thousand nodes meet in one task."""

    def merge(table: pa.Table) -> pa.Table:
        return _list_table(*_best_lists(*_offered(table), k))

    return offers.groupBy("bucket").applyInArrow(merge, _LISTS)


_EDGES = "id long, other long, sim float, at int"


def _edges(lists: DataFrame) -> DataFrame:
    """A row for each entry of the lists, with its place."""

    def explode(batches):
        for batch in batches:
            ids, row = _flat(pa.chunked_array([batch.column(1)]), np.int64)
            sims, _ = _flat(pa.chunked_array([batch.column(2)]), np.float32)
            first = np.searchsorted(row, np.arange(batch.num_rows))
            owner = batch.column(0).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(ids), pa.array(sims), pa.array((np.arange(len(row)) - first[row]).astype(np.int32))], ["id", "other", "sim", "at"])

    return lists.select("id", "ids", "sims").mapInArrow(explode, _EDGES)


def _back(edges: DataFrame, reverse: int) -> DataFrame:
    """``id``, ``other``: of each node the nearest nodes whose lists hold it, at most ``reverse``."""
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    turned = edges.select(F.col("other").alias("id"), F.col("id").alias("other"), "sim")
    return turned.withColumn("at", F.row_number().over(order)).where(F.col("at") <= reverse).select("id", "other")


def _compared(table: pa.Table, k: int, offers: int, buckets: int) -> pa.Table:
    """Offers from the neighbours of each node, compared with each other. Codes are decoded for 256 nodes at a time."""
    node, other, bar = (table[n].to_numpy() for n in ("id", "other", "bar"))
    raw = _raw(table["code"])
    order = np.lexsort((other, node))
    order = order[np.concatenate([[True], (node[order][1:] != node[order][:-1]) | (other[order][1:] != other[order][:-1])])]
    node, other, bar = node[order], other[order], bar[order]
    start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    size = np.diff(np.append(start, len(node)))
    column = np.arange(len(node)) - np.repeat(start, size)
    width, best = int(size.max()), [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)]
    found_now: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(start), 256):
        low, high = start[at], start[at + 255] + size[at + 255] if at + 255 < len(start) else len(node)
        codes = _floats(raw[order[low:high]])
        row = np.repeat(np.arange(len(size[at : at + 256])), size[at : at + 256])
        x = np.zeros((len(size[at : at + 256]), width, codes.shape[1]), np.float32)
        x[row, column[low:high]] = codes
        index = np.full(x.shape[:2], -1, np.int64)
        index[row, column[low:high]] = np.arange(low, high)
        h = np.zeros(x.shape[:2], np.float32)
        h[row, column[low:high]] = _halves(codes)
        s = x @ x.transpose(0, 2, 1) - h[:, :, None] - h[:, None, :]
        s[np.broadcast_to((index < 0)[:, None, :], s.shape)] = _LOWEST
        s[:, np.arange(width), np.arange(width)] = _LOWEST
        take = min(offers, width - 1)
        if take < 1:
            continue
        top = np.argpartition(-s, take - 1, axis=2)[:, :, :take]
        found = np.take_along_axis(s, top, 2)
        of = np.broadcast_to(index[:, :, None], found.shape)
        to = np.take_along_axis(np.broadcast_to(index[:, None, :], s.shape), top, 2)
        good = (of >= 0) & (to >= 0)
        good &= found > np.where(good, bar[of], np.inf)
        for kept, new in zip(found_now, (other[of[good]], other[to[good]], found[good]), strict=True):
            kept.append(new)
        # What has come together is cut to the k best of each node before more comes.
        if sum(map(len, found_now[0])) > max(1 << 18, len(best[0])) or at + 256 >= len(start):
            best = list(_best_lists(*(np.concatenate([b, *kept]) for b, kept in zip(best, found_now, strict=True)), k))
            found_now = [[], [], []]
    return _offer_table(*best, buckets)


def _round(lists: DataFrame, nodes: DataFrame, k: int, reverse: int, offers: int, buckets: int) -> DataFrame:
    """Lists improved by comparing the neighbours of each node with each other, and how many entries of each are new."""
    edges = _edges(lists)
    back = _back(edges.where(F.col("at") < reverse), reverse)
    members = edges.select("id", "other").union(back)
    # The weakest entry of a full list is the bar for offers to that node.
    def bars(batches):
        for batch in batches:
            low = [np.frombuffer(s, np.float32) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(s[-1]) if len(s) >= k else -1e30 for s in low], pa.float32())], ["id", "bar"])

    barred = nodes.select("id", "code").join(lists.select("id", "sims").mapInArrow(bars, "id long, bar float"), "id").select(F.col("id").alias("other"), "code", "bar")
    met = members.join(barred, "other").withColumn("bucket", _bucket_of("id", buckets))

    def local(table: pa.Table) -> pa.Table:
        return _compared(table, k, offers, buckets)

    offered = met.select("bucket", "id", "other", "code", "bar").groupBy("bucket").applyInArrow(local, _OFFERS)

    def improve(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, row = _flat(left["ids"], np.int64)
        own = left["id"].to_numpy()[row], ids, _flat(left["sims"], np.float32)[0]
        owner, ids, sims = _best_lists(*map(np.concatenate, zip(own, _offered(right), strict=True)), k)
        pair = lambda a, b: a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        new = ~np.isin(pair(owner, ids), pair(*own[:2]))
        out = _list_table(owner, ids, sims)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
        return out.append_column("changed", pa.array(np.add.reduceat(new, starts, dtype=np.int32) if len(owner) else np.empty(0, np.int32), pa.int32()))

    return lists.withColumn("bucket", _bucket_of("id", buckets)).groupBy("bucket").cogroup(offered.groupBy("bucket")).applyInArrow(improve, f"{_LISTS}, changed int")


def _adjacency(lists: DataFrame, nodes: DataFrame, reverse: int, buckets: int) -> DataFrame:
    """``id``, ``ids``, ``codes``: each node's neighbours, forward and reverse, with their codes."""
    edges = _edges(lists)
    both = edges.select("id", "other").union(_back(edges, reverse)).distinct()
    met = both.join(nodes.select(F.col("id").alias("other"), "code"), "other").withColumn("bucket", _bucket_of("id", buckets))

    def pack(table: pa.Table) -> pa.Table:
        node, other = table["id"].to_numpy(), table["other"].to_numpy()
        order = np.argsort(node, kind="stable")
        node = node[order]
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        raw, cuts = _raw(table["code"])[order], np.append(start, len(node))
        # The rows of a node lie together, so that its list is a stretch of one buffer.
        joined = lambda x: pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((cuts * x[:1].nbytes).astype(np.int32)), pa.py_buffer(x)])
        return pa.table({"id": pa.array(node[start]), "ids": joined(other[order]), "codes": joined(raw)})

    return met.select("bucket", "id", "other", "code").groupBy("bucket").applyInArrow(pack, "id long, ids binary, codes binary")


_STATE = "part int, query long, code binary, ids binary, sims binary, done binary, next binary"


def _state_row(part: int, query: int, code: bytes, ids: np.ndarray, sims: np.ndarray, done: np.ndarray, width: int, pool: int, first: int | None = None) -> tuple:
    """A query's candidates, best first, those expanded so far, and those to expand next, ``first`` in any case."""
    _, ids, sims = _best_lists(np.zeros(len(ids), np.int64), ids, sims, pool)
    after = ids[~np.isin(ids, done)][:width]
    if first is not None and first not in after:
        after = np.append(after, first)
    return part, query, code, ids.tobytes(), sims.tobytes(), np.concatenate([done, after]).tobytes(), after.tobytes()


def _state_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    names = [f.split()[0] for f in _STATE.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(names)})


def _start(nodes: DataFrame, queries: DataFrame, entries: pa.Table, parts: int, width: int, pool: int) -> DataFrame:
    """Each query at its own node and at the common entries."""
    own = nodes.join(queries, "id", "left_semi").select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "code")
    entry_ids, entry_codes = entries["id"].to_numpy(), _codes(entries["code"])[:, :-1]

    def begin(batches):
        for batch in batches:
            rows = []
            for part, node, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = _decoded([code])[0, :-1]
                # Its own node too: other vectors may equal the query's.
                near = np.append(entry_ids, node), np.append(entry_codes @ x, x @ x).astype(np.float32)
                rows.append(_state_row(part, node, code, *near, np.empty(0, np.int64), width, pool, first=node))
            yield from _state_table(rows).to_batches()

    return own.mapInArrow(begin, _STATE)


def _step(state: DataFrame, adjacency: DataFrame, width: int, pool: int) -> DataFrame:
    """Expand each query's next candidates: one join with the graph for all queries."""

    def spread(batches):
        for batch in batches:
            nodes, row = _flat(pa.chunked_array([batch.column(3)]), np.int64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(3)), pa.array(nodes)], ["part", "query", "code", "id"])

    wanted = state.select("part", "query", "code", "next").mapInArrow(spread, "part int, query long, code binary, id long")

    def score(batches):
        for batch in slices(batches, 4):
            sims = []
            for code, codes in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                # The query's own last component counts as 0.
                x = _decoded([code])[0, :-1]
                near = _decoded([codes[a : a + len(code)] for a in range(0, len(codes), len(code))])
                sims.append((near[:, :-1] @ x).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(sims, pa.binary())], ["part", "query", "ids", "sims"])

    seen = wanted.join(adjacency, "id").select("part", "query", "code", "ids", "codes").mapInArrow(score, "part int, query long, ids binary, sims binary")

    def advance(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, row = _flat(right["ids"], np.int64)
        sims, _ = _flat(right["sims"], np.float32)
        owner = right["query"].to_numpy()[row]
        order = np.argsort(owner, kind="stable")
        owner, ids, sims = owner[order], ids[order], sims[order]
        rows = []
        for part, query, code, own, own_sims, done in zip(*(left[n].to_pylist() for n in ("part", "query", "code", "ids", "sims", "done")), strict=True):
            a, b = np.searchsorted(owner, [query, query + 1])
            every = np.concatenate([np.frombuffer(own, np.int64), ids[a:b]]), np.concatenate([np.frombuffer(own_sims, np.float32), sims[a:b]])
            rows.append(_state_row(part, query, code, *every, np.frombuffer(done, np.int64), width, pool))
        return _state_table(rows)

    return state.groupBy("part").cogroup(seen.groupBy("part")).applyInArrow(advance, _STATE)


def nearest(
    vectors: DataFrame,
    queries: F.Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    degree: int = 32,
    trees: int = 5,
    block: int = 2048,
    rounds: int = 3,
    reverse: int = 16,
    offers: int = 8,
    widths: tuple[int, ...] = (32, 96, 96, 96),
    pool: int = 240,
    sample_rows: int = 20_000,
    entry_rows: int = 256,
    changed: float = 0.001,
    nodes_per_task: int = 4096,
    queries_per_task: int = 128,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k nearest found of each query by inner product.

    Every row is a node of the graph or equals one; the planes of the trees
    are drawn from ``sample_rows`` rows at most. ``queries`` is a condition on
    the input that marks query rows; a query's own id is never its result,
    ties go to the smaller id and scores are exact on the original vectors.
    Rows with a null id, a null or zero vector, or null or non-finite
    components take no part; shorter vectors count as followed by zeros. Rows
    that repeat are found once. An empty table gives no rows. Other columns
    are ignored. Rounds end, after ``rounds`` of them at least, when a round
    changes no more than the share ``changed`` of the list entries. ``widths``
    has the candidates expanded in each step of a search; the last goes on
    until no query has an unexpanded candidate among its best ``pool``. A
    larger ``pool`` raises recall. Searches also start at the ``entry_rows``
    longest vectors and as many drawn by hash.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    folder = new_folder(spark, "neighbours")
    good = F.expr(
        "v IS NOT NULL AND id IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)"
    )
    marked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("is_query"))
    rows = marked.where(good).dropDuplicates(["id", "v"])
    classes = written(rows.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("size")), f"{folder}/classes")
    n = classes.count()
    buckets = max(1, -(-n // nodes_per_task))
    nodes = written(_coded(classes.select(F.col("node").alias("id"), "v")), f"{folder}/nodes")
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("code").toArrow()
    planes = Trees(_codes(sample["code"]), max(4, block * min(sample_rows, n) // max(n, 1)), trees)
    lists = written(_merged(_first_offers(nodes, planes, block, degree, buckets), degree), f"{folder}/lists0")
    r, share = 0, 1.0
    while r < rounds or share > changed:
        r += 1
        lists = written(_round(lists, nodes, degree, reverse, offers, buckets), f"{folder}/lists{r}")
        remove(spark, f"{folder}/lists{r - 1}")
        new, entries = lists.agg(F.sum("changed"), F.sum(F.length("ids") / 8)).first()
        share = (new or 0) / (entries or 1)
    adjacency = written(_adjacency(lists, nodes, degree, buckets), f"{folder}/adjacency")

    members = rows.join(classes.where("size > 1").select("v", "node"), "v")
    asked = rows.where("is_query").join(classes.select("v", "node"), "v").select(F.col("id").alias("query_id"), "node", "v")
    asked = written(asked, f"{folder}/asked")
    parts = max(1, -(-asked.count() // queries_per_task))
    longest = nodes.orderBy(F.desc("length"), "id").limit(entry_rows)
    drawn = nodes.orderBy(F.xxhash64("id"), "id").limit(entry_rows)
    entries = longest.union(drawn).select("id", "code").distinct().toArrow()
    s, state = 0, written(_start(nodes, asked.select(F.col("node").alias("id")), entries, parts, widths[0], pool), f"{folder}/state0")
    while state.where(F.length("next") > 0).limit(1).count():
        s += 1
        state = written(_step(state, adjacency, widths[min(s, len(widths) - 1)], pool), f"{folder}/state{s}")
        remove(spark, f"{folder}/state{s - 1}")

    # All candidates, as codes are rounded; each class gives its first k + 1 ids.
    first = Window.partitionBy("node").orderBy("id")
    copies = members.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1).select("node", "id")
    ids = classes.where("size = 1").select("node", F.col("node").alias("id")).union(copies)
    near = _edges(state.select(F.col("query").alias("id"), "ids", "sims")).select(F.col("id").alias("start"), F.col("other").alias("node"))
    scored = (
        near.join(asked.select(F.col("node").alias("start"), "query_id", F.col("v").alias("q")), "start")
        .join(classes.select("node", "v"), "node")
        .select("query_id", "node", F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))).alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = scored.join(ids, "node").where("id <> query_id").select("query_id", F.col("id").alias("vec_id"), "score").distinct()
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
