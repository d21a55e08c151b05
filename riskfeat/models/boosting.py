"""Boosting with any loss over Spark ML regression trees: Newton steps, and draws of rows and
columns that a retry or another partitioning cannot change.

Every round a regression tree is fitted to -g / h with weight h, g and h being the derivatives
of the loss by the margin. Splits of least weighted variance are those of the largest gain in
loss, and a leaf's value is -sum(g) / (sum(h) + l2). Spark's own boosting knows the logistic
loss only and draws columns for each node; here columns are drawn once a tree and rows once
for ``redraw`` rounds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.models import trees as forest
from riskfeat.models.pairwise import PairGradients, curve
from riskfeat.session import keep, materialize

LOGISTIC, PAIRWISE = "logistic", "pairwise"
#: Rounds between two cuts of the lineage.
CUT_EVERY = 10
#: A second derivative of 0 would give a row no weight and an infinite target.
LEAST_WEIGHT = 1e-12


def row_draw(key: str, share: float, seed: int, draw: int) -> Column:
    """Whether a row is in a draw, from its key alone: the first 32 bits of an MD5."""
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(draw)))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return number < F.lit(math.ceil(share * 2**32))


def column_draw(columns: int, share: float, seed: int, tree: int) -> list[int]:
    """The columns of a tree: those with the smallest hashes of (column, seed, tree)."""
    def mark(column: int) -> str:
        return hashlib.md5(f"{column}:{seed}:{tree}".encode()).hexdigest()

    return sorted(sorted(range(columns), key=mark)[: max(1, math.ceil(share * columns))])


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted ensemble; ``transform`` adds margin and probability."""

    trees: forest.FlatTrees | None
    start: float
    features: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        if self.trees is None:
            margin = df.withColumn("margin", F.lit(self.start))
        else:
            margin = forest.add_margin(df, self.trees, "margin", self.start, self.features)
        p = curve(F.col("margin"))
        return margin.withColumn("probability", array_to_vector(F.array(1 - p, p)))

    def staged(self, df: DataFrame, name: str = "margins") -> DataFrame:
        """``name``: the margin after every round, as an array."""
        if self.trees is None:
            return df.withColumn(name, F.array().cast("array<double>"))
        return forest.add_staged_margins(df, self.trees, name, self.start, self.features)


@dataclass(frozen=True)
class Booster:
    """Settings of one boosted scorer. ``l2`` is added to the weight of a leaf, ``redraw`` is
    for how many rounds a draw of rows holds."""

    objective: str
    step: float
    rounds: int
    depth: int = 5
    row_share: float = 0.7
    column_share: float = 0.7
    redraw: int = 1
    l2: float = 1.0
    max_bins: int = 32
    min_rows_per_leaf: int = 1
    seed: int = 10
    features: str = "features"
    label: str = "target"
    key: str = "id"

    def derivatives(self, rows: DataFrame) -> Callable[[DataFrame], DataFrame] | None:
        """What adds ``g__`` and ``h__``; None where there is nothing to learn."""
        if self.objective == PAIRWISE:
            found = PairGradients.fit(rows, self.label, "margin__")
            return found and (lambda df: found.added(df, self.label, "margin__", "g__", "h__"))
        p = curve(F.col("margin__"))
        return lambda df: df.withColumns({"g__": p - F.col(self.label), "h__": p * (1 - p)})

    def first_margin(self, rows: DataFrame) -> float:
        """The prior log odds; ranking has no level, so 0."""
        if self.objective == PAIRWISE:
            return 0.0
        mean = rows.agg(F.avg(self.label)).first()[0]
        mean = min(max(0.5 if mean is None else mean, 1e-6), 1 - 1e-6)
        return math.log(mean / (1 - mean))

    def fit(self, df: DataFrame) -> BoostedTrees:
        """Rows need ``key``, ``label`` (0 or 1) and the vector ``features``."""
        rows = df.select(self.key, self.label, self.features).where(F.col(self.label).isin(0, 1))
        first = rows.select(self.features).first()
        if first is None:
            return BoostedTrees(None, 0.0, self.features)
        columns, start = len(first[0]), self.first_margin(rows)
        state, before = keep(rows.withColumn("margin__", F.lit(start))), None
        parts: list[forest.FlatTrees] = []
        learner = DecisionTreeRegressor(
            featuresCol="drawn__", labelCol="aim__", weightCol="weight__", leafCol="leaf__", maxDepth=self.depth, maxBins=self.max_bins,
            minInstancesPerNode=self.min_rows_per_leaf, seed=self.seed,
        )
        for t in range(self.rounds):
            add_derivatives = self.derivatives(state)
            if add_derivatives is None:
                break
            chosen = column_draw(columns, self.column_share, self.seed, t)
            slicer = VectorSlicer(inputCol=self.features, outputCol="drawn__", indices=chosen)
            within = row_draw(self.key, self.row_share, self.seed, t // self.redraw) if self.row_share < 1 else F.lit(True)
            weight = F.greatest(F.col("h__"), F.lit(LEAST_WEIGHT))
            drawn = add_derivatives(state.where(within))
            drawn = keep(slicer.transform(drawn.withColumns({"weight__": weight, "aim__": -F.col("g__") / weight})).select("drawn__", "aim__", "weight__", "g__", "h__"))
            if drawn.isEmpty():
                drawn.unpersist()
                continue
            tree = learner.fit(drawn)
            leaves = {int(r[0]): -r[1] / (r[2] + self.l2) for r in tree.transform(drawn).groupBy("leaf__").agg(F.sum("g__"), F.sum("h__")).collect()}
            drawn.unpersist()
            if before is not None:  # the state made of it is held by now
                before.unpersist()
            found = forest.flat(tree)
            values = [self.step * leaves.get(i, 0.0) for i in range(int((found.feature < 0).sum()))]
            parts.append(forest.with_leaf_values(found, values).moved_to(chosen))
            held = tree.transform(slicer.transform(state))
            after = held.select(*rows.columns, (F.col("margin__") + F.get(F.lit(values), F.col("leaf__").cast("int"))).alias("margin__"))
            before, state = state, materialize(after) if (t + 1) % CUT_EVERY == 0 else keep(after)
        for held in (before, state):
            if held is not None:
                held.unpersist()
        return BoostedTrees(forest.joined(parts) if parts else None, start, self.features)
