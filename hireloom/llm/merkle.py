"""Merkle manifest of a table: a ternary hash tree per group, one over the groups, and a proof for each row.

1. Leaves (digests of the rows) are sorted by range partitions and numbered per
   group: place in the partition, plus what earlier partitions hold of the group.
2. Bottom up: a superblock is a complete subtree of 3**k leaves. Each is reduced
   to its top node where its leaves lie; the nodes are the leaves of the next
   turn, until every group has one node. The groups' roots are one more tree.
3. Top down: a superblock's nodes are cogrouped with the outer nodes that lead
   from its top to the root. The function reduces the superblock again, joins each
   node's siblings inside with those outside, and the last turn folds the leaves.
   A leaf travels once per turn and no task sees more than its superblocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hireloom.llm.shared import bounded_batches, new_folder, partitions, remove, written

_ARITY = 3


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(count: int) -> int:
    """How often ``count`` nodes are combined until one remains."""
    n = 0
    while count > 1:
        count, n = -(-count // _ARITY), n + 1
    return n


def parents(nodes: list[str]) -> list[str]:
    return [sha(*nodes[i : i + _ARITY]) for i in range(0, len(nodes), _ARITY)]


def subtree(nodes: list[str], height: int) -> list[list[str]]:
    """The levels of a subtree, from its lowest nodes up to its top."""
    out = [nodes]
    for _ in range(height):
        out.append(parents(out[-1]))
    return out


def siblings(tree: list[list[str]], at: int) -> list[str]:
    """For each level below the top, "nodes on the left|nodes on the right" of the node's run."""
    steps = []
    for nodes in tree[:-1]:
        start = at - at % _ARITY
        steps.append("".join(nodes[start:at]) + "|" + "".join(nodes[at + 1 : start + _ARITY]))
        at //= _ARITY
    return steps


def folded(leaf: str, steps: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for step in steps:
        left, right = step.split("|")
        leaf = sha(left, leaf, right)
    return leaf


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``at``, the place of each row among those of its tree, to a partition sorted by tree."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("tree").dictionary_encode()
        code = codes.indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sizes = np.diff(np.append(starts, len(code)))
        at = np.arange(len(code)) - np.repeat(starts, sizes)
        if codes.dictionary[int(code[0])].as_py() == last:
            at[: sizes[0]] += seen
        last, seen = codes.dictionary[int(code[-1])].as_py(), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "at"])


def _ranked(rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """``rows`` with ``at``, the place in their ``tree`` by ``order``, and ``left``, the height of the tree.

    Rows are dealt by ranges, so a large tree lies in many partitions; the
    column ``spread`` deals rows that are equal in all else.
    """
    by = ["tree", *order, "spread"]
    placed = rows.repartitionByRange(max(1, partitions(rows.sparkSession)), *by).sortWithinPartitions(*by)
    placed = placed.drop("spread").withColumn("part", F.spark_partition_id())
    schema = StructType([*placed.schema.fields, StructField("at", LongType())])
    placed = written(placed.mapInArrow(_number, schema), folder)
    # A row for each tree and partition with some of it: for a large tree, as many as partitions.
    held = placed.groupBy("tree", "part").agg(F.count("*").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("tree").orderBy("part"))
    held = held.select("tree", "part", (upto - F.col("held")).alias("before"), F.sum("held").over(Window.partitionBy("tree")).alias("n"))
    height = F.expr(f"cast(size(filter(sequence(0, 39), i -> pow({_ARITY}D, i) < n)) AS int)")
    found = placed.join(held, ["tree", "part"])
    return found.select(*[c for c in rows.columns if c != "spread"], (F.col("at") + F.col("before")).alias("at"), height.alias("left"))


def _in_cells(nodes: DataFrame, height: int, cells: int) -> DataFrame:
    """Superblocks, each whole in one of about ``cells`` cells."""
    block = F.expr(f"at div {_ARITY**height}")
    return nodes.withColumn("block", block).withColumn("cell", F.pmod(F.xxhash64("tree", "block"), F.lit(cells)))


def _blocks(nodes: pd.DataFrame, height: int) -> Iterator[tuple[str, int, int, list[int], list[list[str]]]]:
    """Tree, number, height left, row positions and levels of every superblock of a cell."""
    nodes = nodes.sort_values(["tree", "at"], kind="stable")
    keys = zip(nodes["tree"], nodes["block"], nodes["left"], range(len(nodes)), nodes["node"], strict=True)
    for (tree, block), rows in groupby(keys, key=lambda r: r[:2]):
        rows = list(rows)
        own = min(height, int(rows[0][2]))
        yield tree, int(block), int(rows[0][2]) - own, [int(nodes.index[r[3]]) for r in rows], subtree([r[4] for r in rows], own)


_UP = "tree string, at long, left int, node string"
_OUTER = "tree string, at long, steps array<string>, subroot string, root string"


def _reducer(height: int):
    def reduced(nodes: pd.DataFrame) -> pd.DataFrame:
        tops = [(tree, block, left, tree_levels[-1][0]) for tree, block, left, _, tree_levels in _blocks(nodes, height)]
        return pd.DataFrame(tops, columns=["tree", "at", "left", "node"])

    return reduced


def _joiner(height: int, payload: list[str]):
    """Siblings inside a superblock, then those of its top; with a ``changed`` column also the root it folds to."""

    def join(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        above = {(t, int(a)): (list(s), u, r) for t, a, s, u, r in zip(outer["tree"], outer["at"], outer["steps"], outer["subroot"], outer["root"], strict=True)}
        nodes = nodes.reset_index(drop=True)
        size = len(nodes)
        steps, subroots, roots, folds = [None] * size, [None] * size, [None] * size, [None] * size
        changed = nodes["changed"].tolist() if "changed" in payload else None
        for tree, block, _, rows, tree_levels in _blocks(nodes, height):
            rest, subroot, root = above[tree, block]
            for i, at in enumerate(rows):
                steps[at], subroots[at], roots[at] = siblings(tree_levels, i) + rest, subroot, root
                if changed:
                    folds[at] = folded(changed[at], steps[at])
        out = nodes[payload].copy()
        out["steps"], out["subroot"], out["root"] = pd.Series(steps, dtype=object), pd.Series(subroots, dtype=object), pd.Series(roots, dtype=object)
        if changed is not None:
            out["folded_root"] = pd.Series(folds, dtype=object)
        return out

    return join


class _Forest:
    """Nodes of all trees, a turn of superblocks at a time: up to the roots, then down with their proofs."""

    def __init__(self, leaves: DataFrame, folder: str, height: int, cell_rows: int):
        self.folder, self.height, self.cell_rows = folder, height, cell_rows
        self.turns = [written(leaves, f"{folder}/leaves")]
        self.tops = None
        while True:
            nodes = self.turns[-1]
            turn = len(self.turns) - 1
            cut = _in_cells(nodes.select("tree", "at", "left", "node"), height, self._cells(nodes))
            up = written(cut.groupBy("cell").applyInPandas(_reducer(height), _UP), f"{folder}/up{turn}")
            done = up.where("left = 0").select("tree", F.lit(turn).alias("turn"), "node")
            self.tops = done if self.tops is None else self.tops.union(done)
            rest = up.where("left > 0")
            if rest.isEmpty():
                break
            self.turns.append(rest)

    def _cells(self, nodes: DataFrame) -> int:
        return max(1, nodes.count() // self.cell_rows)

    def proofs(self, tops: DataFrame) -> DataFrame:
        """For each leaf its columns, ``steps``, ``subroot`` and ``root``, from those ``(tree, turn, steps, subroot, root)`` of every tree."""
        found = None
        for turn in reversed(range(len(self.turns))):
            nodes = self.turns[turn]
            outer = tops.where(F.col("turn") == turn).select("tree", F.lit(0).cast("long").alias("at"), "steps", "subroot", "root")
            outer = outer if found is None else outer.union(found)
            payload = [f for f in nodes.schema.fields if turn == 0 or f.name in ("tree", "at")]
            more = [f for f in ("steps array<string>", "subroot string", "root string")]
            more += ["folded_root string"] if any(f.name == "changed" for f in payload) else []
            schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in payload] + more)
            cells = self._cells(nodes)
            left = _in_cells(nodes, self.height, cells).groupBy("cell")
            right = _in_cells(outer, 0, cells).groupBy("cell")
            found = left.cogroup(right).applyInPandas(_joiner(self.height, [f.name for f in payload]), schema)
            found = written(found, f"{self.folder}/down{turn}") if turn else found
        return found


def merkle_manifest(
    table: DataFrame,
    columns: list[str],
    id_col: str = "doc_id",
    group_col: str = "source",
    found: dict[str, Column] | None = None,
    height: int = 7,
    cell_rows: int = 8192,
) -> DataFrame:
    """One row per input row: ``id_col``, ``leaf``, ``subroot``, ``root``, ``proof``, ``folded_root``, ``verified``.

    A leaf is the SHA-256 (lower-case hex) of the ``columns``, each as ``field``
    writes it. In each group leaves ascend by id, rows of equal ids by leaf; every
    three nodes become one (a last run may hold fewer) until one, the subroot,
    remains. Subroots, ordered by group bytewise with null first, give the root
    likewise. ``proof`` has a step for each level, "siblings left|siblings right".
    ``found`` gives columns as they are found now, for those rows where its value
    is not null; ``folded_root`` is what the leaf of the found row and the
    original siblings lead to, and ``verified`` whether that is the root.

    Null ids come first; a null group is a group; other nulls are written as
    ``-`` and differ from empty texts. Rows that repeat are leaves each. An empty
    table gives no rows. Long texts are hashed once, where they are read, and
    only digests travel. Columns with other names are ignored. ``height`` is that
    of a superblock (3**height leaves). Tables of the steps are written to the
    shared folder; the returned frame still reads the last of them.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    folder = new_folder(spark, "merkle")
    now = [F.coalesce((found or {}).get(c, F.lit(None)), F.col(c)) for c in columns]
    group = F.col(group_col).cast("string")
    rows = table.select(
        # Trees without null, in the order of the groups.
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"),
        F.col(id_col).cast("long").alias("id"),
        digest(*[F.col(c) for c in columns]).alias("node"),
        (digest(*now) if found else F.lit(None).cast("string")).alias("changed"),
        F.monotonically_increasing_id().alias("spread"),
    )
    rows = written(rows.withColumn("changed", F.coalesce("changed", "node")), f"{folder}/rows")
    forest = _Forest(_ranked(rows, ["id", "node"], f"{folder}/ranked"), f"{folder}/groups", height, cell_rows)
    groups = forest.tops.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "turn", "node", F.lit(0).alias("spread"))
    above = _Forest(_ranked(groups.withColumnRenamed("turn", "group_turn"), ["group"], f"{folder}/ranked_groups"), f"{folder}/root", height, cell_rows)
    top = above.tops.select("tree", "turn", F.array().cast("array<string>").alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    tops = above.proofs(top).select(F.col("group").alias("tree"), F.col("group_turn").alias("turn"), "steps", F.col("node").alias("subroot"), "root")
    tops = written(tops, f"{folder}/tops")
    proofs = forest.proofs(tops)
    for name in ("rows", "ranked", "ranked_groups", "root"):
        remove(spark, f"{folder}/{name}")
    return proofs.select(
        F.col("id").alias(id_col),
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        F.col("steps").alias("proof"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
