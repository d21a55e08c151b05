"""Fitted tree ensembles as flat tables of nodes, and what each tree adds to a row's margin.

Spark ML scores a row with the whole ensemble only. The flat form gives the running sum after
every tree in one pass over the rows, so a figure of each round needs no fit of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREE = re.compile(r"\s*Tree \d+ \(weight ([-+.\dE]+)\):")
SPLIT = re.compile(r"\s*If \(feature (\d+) (?:<= ([-+.\dE]+)|(not )?in \{([^}]*)\})\)")
LEAF = re.compile(r"\s*Predict: (\S+)")
#: Rows whose running sums are held at a time in a task.
ROWS = 1024


@dataclass(frozen=True)
class FlatTrees:
    """Nodes of all trees one after another. ``feature`` is -1 at a leaf; a split sends a row
    left by ``threshold``, or by row ``subset`` of ``members`` where that is not -1."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    subset: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    members: np.ndarray

    def __len__(self) -> int:
        return len(self.roots)

    def used(self) -> list[int]:
        """The features of any split, in order; one at least, so that a vector can be cut."""
        return sorted(set(self.feature[self.feature >= 0].tolist())) or [0]

    def on(self, used: list[int]) -> FlatTrees:
        """The same trees over vectors that hold only the ``used`` features."""
        place = {f: i for i, f in enumerate(used)}
        return replace(self, feature=np.array([place.get(f, -1) for f in self.feature.tolist()], np.int32))

    def moved_to(self, columns: list[int]) -> FlatTrees:
        """The same trees over vectors of which the present ones hold the ``columns``."""
        return replace(self, feature=np.where(self.feature >= 0, np.array(columns)[self.feature], -1).astype(np.int32))

    def output(self, tree: int, rows: np.ndarray) -> np.ndarray:
        """What one tree gives each row."""
        at = np.full(len(rows), self.roots[tree])
        every = np.arange(len(rows))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.value[at]
            x = rows[every, np.maximum(feature, 0)]
            goes_left = x <= self.threshold[at]
            subset = self.subset[at]
            if (subset >= 0).any():
                code = np.clip(x, 0, self.members.shape[1] - 1).astype(np.int64)
                goes_left = np.where(subset >= 0, self.members[subset, code], goes_left)
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)


def flat(model: Model | str, weight: Callable[[int], float] | None = None) -> FlatTrees:
    """The trees of a fitted Spark ML tree model, or of its description. Leaf values are
    multiplied by each tree's own weight, or by ``weight(tree)``."""
    lines = (model if isinstance(model, str) else model.toDebugString).splitlines()
    trees: list[tuple[float, list[str]]] = []
    for line in lines[1:]:
        if m := TREE.match(line):
            trees.append((float(m[1]), []))
        elif line.strip():
            if not trees:  # a single tree has no heading
                trees.append((1.0, []))
            trees[-1][1].append(line)
    return build([(w if weight is None else weight(i), body) for i, (w, body) in enumerate(trees)])


def build(trees: list[tuple[float, list[str]]]) -> FlatTrees:
    roots, nodes, subsets = [], [], []

    def node(lines: list[str]) -> None:
        """Reads one subtree in the order of the description; without recursion on the data's
        side, as a tree is no deeper than its setting."""
        nodes.append([-1, 0.0, -1, 0, 0, 0.0])
        here = len(nodes) - 1
        line = lines.pop()
        if m := LEAF.match(line):
            nodes[here][5] = weight * float(m[1])
            return
        m = SPLIT.match(line)
        nodes[here][0] = int(m[1])
        if m[2] is not None:
            nodes[here][1] = float(m[2])
        else:
            subsets.append((m[3] is not None, [int(float(x)) for x in m[4].split(",") if x]))
            nodes[here][2] = len(subsets) - 1
        nodes[here][3] = len(nodes)
        node(lines)
        lines.pop()  # Else
        nodes[here][4] = len(nodes)
        node(lines)

    for weight, lines in trees:
        roots.append(len(nodes))
        node(lines[::-1])
    most = max((max(s, default=0) for _, s in subsets), default=0) + 2  # the last place: any larger code
    members = np.zeros((max(len(subsets), 1), most), bool)
    for i, (negated, codes) in enumerate(subsets):
        members[i, codes] = True
        if negated:
            members[i] = ~members[i]
    feature, threshold, subset, left, right, value = (np.array(c) for c in zip(*nodes)) if nodes else (np.zeros(0),) * 6
    return FlatTrees(np.array(roots, np.int64), feature.astype(np.int32), threshold.astype(float), subset.astype(np.int32), left.astype(np.int64), right.astype(np.int64), value.astype(float), members)


def with_leaf_values(trees: FlatTrees, values: list[float]) -> FlatTrees:
    """The same trees with other values at the leaves, which are counted in the order of the nodes."""
    value = trees.value.copy()
    value[trees.feature < 0] = values
    return replace(trees, value=value)


def joined(parts: list[FlatTrees]) -> FlatTrees:
    """All trees as one ensemble."""
    starts = np.cumsum([0] + [len(p.feature) for p in parts])
    first = np.cumsum([0] + [len(p.members) for p in parts])
    width = max(p.members.shape[1] for p in parts)
    # a code beyond a part's own table is like its last place
    members = np.concatenate([np.pad(p.members, ((0, 0), (0, width - p.members.shape[1])), mode="edge") for p in parts])
    subset = np.concatenate([np.where(p.subset >= 0, p.subset + f, -1) for p, f in zip(parts, first)])

    def moved(name: str) -> np.ndarray:
        return np.concatenate([getattr(p, name) + s for p, s in zip(parts, starts)])

    def plain(name: str) -> np.ndarray:
        return np.concatenate([getattr(p, name) for p in parts])

    return FlatTrees(moved("roots"), plain("feature"), plain("threshold"), subset, moved("left"), moved("right"), plain("value"), members)


def _cut(df: DataFrame, trees: FlatTrees, features: str, name: str) -> tuple[DataFrame, FlatTrees]:
    """``name``: the used features of each row as an array."""
    used = trees.used()
    slicer = VectorSlicer(inputCol=features, outputCol=name, indices=used)
    return slicer.transform(df).withColumn(name, vector_to_array(name)), trees.on(used)


def _rows(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def add_margin(df: DataFrame, trees: FlatTrees, name: str, start: float = 0.0, features: str = "features") -> DataFrame:
    """``name``: ``start`` and the sum of what all trees give the row."""
    cut, own = _cut(df, trees, features, f"{name}__x")
    shared = df.sparkSession.sparkContext.broadcast(own)  # some dozen nodes a tree

    @F.arrow_udf("double")
    def margin(x: pa.Array) -> pa.Array:
        rows = _rows(x)
        total = np.full(len(rows), start)
        for t in range(len(shared.value)):
            total += shared.value.output(t, rows)
        return pa.array(total)

    return cut.withColumn(name, margin(f"{name}__x")).drop(f"{name}__x")


def add_staged_margins(df: DataFrame, trees: FlatTrees, name: str, start: float = 0.0, features: str = "features") -> DataFrame:
    """``name``: an array with the margin after each tree."""
    cut, own = _cut(df, trees, features, f"{name}__x")
    shared = df.sparkSession.sparkContext.broadcast(own)

    @F.arrow_udf("array<double>")
    def margins(x: pa.Array) -> pa.Array:
        rows, parts = _rows(x), []
        n = len(shared.value)
        for i in range(0, len(rows), ROWS):
            some = rows[i : i + ROWS]
            each = np.stack([shared.value.output(t, some) for t in range(n)], axis=1)
            parts.append((start + np.cumsum(each, axis=1)).ravel())
        flat_ = np.concatenate(parts) if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * n, pa.int32()), pa.array(flat_))

    return cut.withColumn(name, margins(f"{name}__x")).drop(f"{name}__x")
