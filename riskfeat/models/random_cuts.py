"""A forest whose splits are drawn, not searched: extremely randomised trees over Spark ML.

The trees come in groups. For each group every feature gets a few cut points of its own, drawn
evenly between its least and largest value by a hash of (feature, cut, group, seed). The features
are bucketed by them, so a tree of the group can split at these points only, and each node
looks at a random choice of features as before. All rows are in every tree.

The trees are regression trees on the 0/1 label: their splits are those of the Gini index, and
a leaf keeps its share of label 1. (Spark's classification trees join leaves that vote alike,
which loses the shares.) The fitted trees are turned back to the features' own scale, so
scoring needs no buckets.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfeat.models import trees as flat_trees
from riskfeat.session import materialize


def drawn_cuts(low: np.ndarray, high: np.ndarray, cuts: int, group: int, seed: int) -> np.ndarray:
    """Sorted cut points of each feature, one row a feature."""
    def share(feature: int, cut: int) -> float:
        digest = hashlib.md5(f"{feature}:{cut}:{group}:{seed}".encode()).digest()
        return int.from_bytes(digest[:8], "big") / 2**64

    shares = np.array([[share(f, c) for c in range(cuts)] for f in range(len(low))]).reshape(len(low), cuts)
    return np.sort(low[:, None] + shares * (high - low)[:, None], axis=1)


@dataclass(frozen=True)
class RandomCutModel:
    """Probability of label 1: the mean share over the trees' leaves."""

    trees: flat_trees.FlatTrees | None
    features: str
    prior: float = 0.5

    def transform(self, df: DataFrame) -> DataFrame:
        if self.trees is None:
            scored = df.withColumn("share__", F.lit(self.prior))
        else:
            scored = flat_trees.add_margin(df, self.trees, "share__", features=self.features)
        return scored.withColumn("probability", array_to_vector(F.array(1 - F.col("share__"), F.col("share__")))).drop("share__")


@dataclass(frozen=True)
class RandomCutForest:
    """``trees`` in groups of ``trees_per_draw``, each group with ``cuts`` cut points a feature."""

    trees: int = 1000
    trees_per_draw: int = 50
    cuts: int = 16
    depth: int = 10
    seed: int = 10
    features: str = "features"
    label: str = "target"
    parallelism: int = 4

    def fit(self, df: DataFrame) -> RandomCutModel:
        rows = materialize(df.select(F.col(self.label).cast("double").alias("label__"), F.col(self.features).alias("all__")).where("label__ IS NOT NULL"))
        if rows.isEmpty():
            return RandomCutModel(None, self.features)
        ends = rows.select(Summarizer.min(F.col("all__")).alias("low"), Summarizer.max(F.col("all__")).alias("high")).first()
        low, high = ends["low"].toArray(), ends["high"].toArray()
        sizes = [min(self.trees_per_draw, self.trees - i) for i in range(0, self.trees, self.trees_per_draw)]

        def fit_group(group: int) -> flat_trees.FlatTrees:
            cuts = drawn_cuts(low, high, self.cuts, group, self.seed)
            return self._fit_group(rows, cuts, sizes[group], group)

        with ThreadPool(self.parallelism) as pool:
            groups = pool.map(inheritable_thread_target(df.sparkSession)(fit_group), range(len(sizes)))
        return RandomCutModel(flat_trees.joined(groups), self.features)

    def _fit_group(self, rows: DataFrame, cuts: np.ndarray, size: int, group: int) -> flat_trees.FlatTrees:
        @F.arrow_udf("array<double>")
        def bucketed(x: pa.Array) -> pa.Array:
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(cuts))
            codes = np.stack([np.searchsorted(c, values[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(float)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(cuts), pa.int32()), pa.array(codes.ravel()))

        learner = RandomForestRegressor(
            featuresCol="codes__", labelCol="label__", numTrees=size, featureSubsetStrategy="log2", maxDepth=self.depth,
            maxBins=self.cuts + 1, subsamplingRate=1.0, bootstrap=False, seed=self.seed + group,
        )
        model = learner.fit(rows.select("label__", array_to_vector(bucketed(vector_to_array("all__"))).alias("codes__")))
        found = flat_trees.flat(model, weight=lambda _: 1 / self.trees)
        # code <= k is x <= cut k
        k = np.clip(np.floor(found.threshold).astype(int), 0, cuts.shape[1] - 1)
        return replace(found, threshold=np.where(found.feature >= 0, cuts[np.maximum(found.feature, 0), k], 0.0))
