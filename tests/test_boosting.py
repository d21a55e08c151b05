"""Ranking gradients, draws, the boosting loop, flat trees and drawn cut points."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskfeat.models import boosting, random_cuts, trees
from riskfeat.models import estimators as est
from riskfeat.models.pairwise import PairGradients
from riskfeat.models.stack import Scorer, add_score, cross_validate, cross_validate_rounds
from riskfeat.operators.encode import nominal
from riskfeat.operators.evaluate import auc, with_fold


def brute_gradients(y, s):
    first, second = np.zeros(len(y)), np.zeros(len(y))
    ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weight = 1 / len(ones) + 1 / len(zeros)
    for i in ones:
        for j in zeros:
            p = 1 / (1 + np.exp(s[i] - s[j]))  # how wrong the pair is
            first[i] -= weight * p
            first[j] += weight * p
            second[[i, j]] += weight * p * (1 - p)
    return first, second


@pytest.mark.parametrize("spread", [0.0, 0.01, 1.0, 8.0, 40.0])
def test_pair_gradients_equal_all_pairs(spark, spread):
    rng = np.random.default_rng(4)
    y, s = (rng.random(500) < 0.2).astype(int), rng.normal(size=500) * spread
    s[::7] = s[0]  # ties within and between the labels
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))] + [(-1, 2, 99.0), (-2, None, 1.0)], "id int, y int, s double")
    g, h = PairGradients.fit(df.repartition(3), "y", "s").columns("y", "s")
    got = df.select("id", "y", g.alias("g"), h.alias("h")).toPandas().set_index("id").sort_index()
    first, second = brute_gradients(y, s)
    assert got.g[got.index >= 0].to_numpy() == pytest.approx(first, abs=1e-8 * np.abs(first).max())
    assert got.h[got.index >= 0].to_numpy() == pytest.approx(second, abs=1e-8 * second.max())
    assert got.loc[[-1, -2], ["g", "h"]].to_numpy().tolist() == [[0, 0], [0, 0]]


def test_pair_gradients_are_compiled_and_the_same(spark, monkeypatch):
    """The loop's derivatives hold no interpreted fold and are those of the fold to the last bit."""
    df = spark.createDataFrame([(i, None if i == 9 else i % 3, i * i / 4e4) for i in range(400)], "id int, y int, s double")
    found = PairGradients.fit(df, "y", "s")
    assert len(found.ones) > 8
    g, h = found.columns("y", "s")
    added = found.added(df, "y", "s", "g", "h")
    assert added.columns == ["id", "y", "s", "g", "h"]
    assert added.orderBy("id").collect() == df.withColumns({"g": g, "h": h}).orderBy("id").collect()
    used, adding = [], PairGradients.added
    monkeypatch.setattr(PairGradients, "added", lambda self, *a: used.append(adding(self, *a)) or used[-1])
    boosting.Booster(boosting.PAIRWISE, 0.2, 1, depth=2).fit(matrix(spark, 100))
    assert "aggregate(" not in used[0]._jdf.queryExecution().optimizedPlan().toString().lower()


def test_pair_gradients_need_both_labels(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.1)], "y int, s double")
    assert PairGradients.fit(df, "y", "s") is None
    assert PairGradients.fit(df.limit(0), "y", "s") is None


def test_row_draws_are_stable_and_hold_for_five_rounds(spark):
    df = spark.range(4000).withColumnRenamed("id", "key")

    def ids(frame, draw, seed=3):
        return {r.key for r in frame.where(boosting.row_draw("key", 0.7, seed, draw)).collect()}

    first = ids(df, 0)
    assert first == ids(df.repartition(13), 0) == ids(df.orderBy(F.rand()), 0)
    assert first != ids(df, 1) and first != ids(df, 0, seed=4)
    assert 0.67 < len(first) / 4000 < 0.73 and 0.45 < len(first & ids(df, 1)) / 4000 < 0.53
    booster = est.BOOST_CATEGORICAL.drawn(10)
    assert [t // booster.redraw for t in range(10)] == [0] * 5 + [1] * 5


def test_column_draws():
    drawn = [boosting.column_draw(10, 0.7, 1, t) for t in range(50)]
    assert all(len(d) == 7 == len(set(d)) and d == sorted(d) for d in drawn)
    assert drawn == [boosting.column_draw(10, 0.7, 1, t) for t in range(50)] and len(set(map(tuple, drawn))) > 30
    assert boosting.column_draw(1, 0.7, 1, 0) == [0] and {c for d in drawn for c in d} == set(range(10))


def matrix(spark, rows=500, seed=3):
    rng = np.random.default_rng(seed)
    x, z, c = rng.normal(size=rows), rng.normal(size=rows), rng.integers(0, 5, size=rows)
    y = x + (c == 3) * 2 + rng.normal(size=rows) / 2 > 0.3
    data = [(i, "test" if i % 7 == 0 else "train", int(y[i]), float(x[i]), float(z[i]), float(c[i])) for i in range(rows)]
    df = spark.createDataFrame(data, "id bigint, split string, target int, x double, z double, c double")
    df = df.withColumn("c", F.col("c").alias("c", metadata=nominal("c", 5)))
    vector = VectorAssembler(inputCols=["x", "z", "c"], outputCol="features").transform(df)
    return with_fold(vector, "id", 3, 111).cache()


def test_flat_trees_equal_the_learner(spark):
    rows = matrix(spark)
    model = GBTClassifier(labelCol="target", maxIter=6, maxDepth=4, seed=1).fit(rows)
    found = trees.flat(model)
    assert len(found) == 6 and (found.subset >= 0).any()
    both = trees.add_margin(model.transform(rows), found, "mine").select("mine", vector_to_array("probability")[1].alias("p")).toPandas()
    assert (1 / (1 + np.exp(-2 * both.mine))).to_numpy() == pytest.approx(both.p.to_numpy())
    staged = trees.add_staged_margins(rows, found, "m").select("m").toPandas()
    assert all(len(m) == 6 for m in staged.m) and [m[-1] for m in staged.m] == pytest.approx(both.mine.to_numpy())
    short = GBTClassifier(labelCol="target", maxIter=2, maxDepth=4, seed=1).fit(rows)
    two = trees.add_margin(rows, trees.flat(short), "m").toPandas().m
    assert [m[1] for m in staged.m] == pytest.approx(two.to_numpy())
    # no rows, and codes that no fit has seen
    assert trees.add_margin(rows.limit(0), found, "m").count() == 0


@pytest.mark.parametrize("objective", [boosting.LOGISTIC, boosting.PAIRWISE])
def test_booster_learns_and_does_not_depend_on_partitions(spark, objective):
    rows = matrix(spark)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    booster = boosting.Booster(objective, 0.5, 6, depth=3, redraw=5, seed=2)
    model = booster.fit(train)
    scored = add_score(test, model, "score")
    assert scored.columns == rows.columns + ["score"]
    assert auc(scored, "target", "score").first().auc > 0.88
    # sums in another order may decide between splits of equal gain, no more
    again = booster.fit(train.repartition(7, "x"))
    both = [m.transform(rows).select("id", "margin").toPandas().set_index("id").margin.sort_index() for m in (model, again)]
    assert len(again.trees) == len(model.trees) and np.corrcoef(*both)[0, 1] > 0.99
    # the margins of the loop are those of the flat trees
    got = model.transform(train).select("id", "margin").toPandas().set_index("id").margin
    staged = model.staged(train).select("id", "margins").toPandas().set_index("id").margins
    assert [m[-1] for m in staged.loc[got.index]] == pytest.approx(got.to_numpy())


def test_ranking_is_as_good_as_logistic_and_odd_inputs_have_a_result(spark):
    rows = matrix(spark, 700, seed=8)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    areas = {o: auc(add_score(test, boosting.Booster(o, 0.5, 6, depth=3).fit(train), "s"), "target", "s").first().auc for o in (boosting.LOGISTIC, boosting.PAIRWISE)}
    assert areas[boosting.PAIRWISE] > areas[boosting.LOGISTIC] - 0.03
    ranking = boosting.Booster(boosting.PAIRWISE, 0.2, 2)
    for some in (train.limit(0), train.where("target = 1"), train.withColumn("target", F.lit(-1))):
        scores = {r.s for r in add_score(test, ranking.fit(some), "s").collect()}
        assert scores == {0.5}


def test_rounds_of_cross_validation(spark):
    """The last round is the figure of the plain cross-validation, by either learner."""
    rows = with_fold(matrix(spark).drop("fold").where("split = 'train'"), "id", 2, 1).cache()
    for estimator in (est.BoostSettings(0.3, 3).estimator(), boosting.Booster(boosting.PAIRWISE, 0.3, 3, depth=3)):
        scorer = Scorer("boost", estimator)
        by_round = {r["round"]: r for r in cross_validate_rounds(rows, scorer, 2, parallelism=2).collect()}
        last = cross_validate(rows, scorer, 2, parallelism=2).toPandas()
        assert sorted(by_round) == [1, 2, 3]
        assert by_round[3].train_mean == pytest.approx(last.train_auc.mean()) and by_round[3].test_mean == pytest.approx(last.test_auc.mean())
        assert by_round[3].test_std == pytest.approx(last.test_auc.std(ddof=0)) and by_round[3].train_mean > by_round[1].train_mean


def test_random_cuts(spark):
    low, high = np.array([0.0, -5.0]), np.array([1.0, 5.0])
    cuts = random_cuts.drawn_cuts(low, high, 200, 0, 1)
    assert cuts.shape == (2, 200) and (np.diff(cuts) >= 0).all() and (cuts >= low[:, None]).all() and (cuts <= high[:, None]).all()
    assert abs(cuts[1].mean()) < 0.7 and not np.allclose(cuts, random_cuts.drawn_cuts(low, high, 200, 1, 1))


def test_random_cut_forest(spark):
    rows = matrix(spark)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    forest = random_cuts.RandomCutForest(trees=30, trees_per_draw=10, cuts=6, depth=5)
    model = forest.fit(train)
    assert len(model.trees) == 30 and auc(add_score(test, model, "s"), "target", "s").first().auc > 0.88
    again = forest.fit(train.repartition(5, "z"))
    assert model.trees.feature.tolist() == again.trees.feature.tolist()
    assert model.trees.threshold.tolist() == again.trees.threshold.tolist()
    # every threshold is one of the group's cuts
    data = np.array([r.features.toArray() for r in train.collect()])
    allowed = {(f, c) for g in range(3) for f, line in enumerate(random_cuts.drawn_cuts(data.min(0), data.max(0), 6, g, 10)) for c in line}
    splits = model.trees.feature >= 0
    assert set(zip(model.trees.feature[splits].tolist(), model.trees.threshold[splits].tolist())) <= allowed
    empty = forest.fit(train.limit(0))
    assert {r.s for r in add_score(test, empty, "s").collect()} == {0.5}
