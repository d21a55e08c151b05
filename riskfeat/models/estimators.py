"""Settings of the scorers and the Spark ML estimators built from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)

from riskfeat.models.boosting import LOGISTIC, PAIRWISE, Booster
from riskfeat.models.random_cuts import RandomCutForest


@dataclass(frozen=True)
class BoostSettings:
    """Boosted trees with logistic loss."""

    step: float
    rounds: int
    depth: int = 5
    row_share: float = 0.7
    column_share: float = 0.7
    seed: int = 10
    max_bins: int = 32
    min_rows_per_leaf: int = 1

    def estimator(self, rounds: int | None = None, features: str = "features", label: str = "target") -> GBTClassifier:
        """``rounds`` overrides the setting, as a trial run would."""
        return GBTClassifier(
            featuresCol=features, labelCol=label, maxDepth=self.depth, stepSize=self.step,
            maxIter=rounds or self.rounds, subsamplingRate=self.row_share,
            featureSubsetStrategy=str(self.column_share), seed=self.seed,
            maxBins=self.max_bins, minInstancesPerNode=self.min_rows_per_leaf,
        )


    def ranking(self, rounds: int | None = None, features: str = "features", label: str = "target") -> Booster:
        """The same settings with the pairwise ranking loss, rows drawn every round and columns
        once a tree."""
        return Booster(
            PAIRWISE, self.step, rounds or self.rounds, self.depth, self.row_share, self.column_share, max_bins=self.max_bins,
            min_rows_per_leaf=self.min_rows_per_leaf, seed=self.seed, features=features, label=label,
        )

    def drawn(self, rounds: int | None = None, redraw: int = 5, features: str = "features", label: str = "target") -> Booster:
        """The same settings with the logistic loss, rows drawn for ``redraw`` rounds and
        columns once a tree."""
        return Booster(
            LOGISTIC, self.step, rounds or self.rounds, self.depth, self.row_share, self.column_share, redraw, l2=0.0,
            max_bins=self.max_bins, min_rows_per_leaf=self.min_rows_per_leaf, seed=self.seed, features=features, label=label,
        )


# The settings of the original scorers.
BOOST_BASE = BoostSettings(step=0.02, rounds=800, seed=1111)
BOOST_SLOWER = BoostSettings(step=0.015, rounds=1200, seed=11)
BOOST_SLOWEST = BoostSettings(step=0.01, rounds=2000, seed=1)
# 25 leaves per tree; depth 5 holds up to 32
BOOST_CATEGORICAL = BoostSettings(step=0.01, rounds=2000, max_bins=200, min_rows_per_leaf=5)
BOOST_ALL_ROWS = BoostSettings(step=0.02, rounds=700, row_share=1.0)
FOREST_TREES = 1000
CROSS_VALIDATION_ROUNDS = 1000
CROSS_VALIDATION_FOLDS, CROSS_VALIDATION_SEED = 5, 10
STACK_FOLDS, STACK_SEED = 5, 111


def forest(trees: int = FOREST_TREES, features: str = "features", label: str = "target", seed: int = 10, depth: int = 10) -> RandomForestClassifier:
    """A forest of searched splits on samples of the rows."""
    return RandomForestClassifier(
        featuresCol=features, labelCol=label, numTrees=trees, featureSubsetStrategy="log2",
        maxDepth=depth, seed=seed,
    )


def random_cut_forest(trees: int = FOREST_TREES, features: str = "features", label: str = "target", seed: int = 10, depth: int = 10) -> RandomCutForest:
    """A forest of drawn cut points on all rows, as the original's."""
    return RandomCutForest(trees=trees, features=features, label=label, seed=seed, depth=depth)


def logistic(rows: int, features: str = "features", label: str = "target", iterations: int = 100, tolerance: float = 1e-6) -> LogisticRegression:
    """L2 with unit weight on the summed loss, hence 1 / rows on the mean loss."""
    return LogisticRegression(
        featuresCol=features, labelCol=label, elasticNetParam=0.0, regParam=1.0 / max(rows, 1),
        standardization=False, maxIter=iterations, tol=tolerance,
    )
