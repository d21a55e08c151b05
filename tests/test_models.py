import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskfeat.models import estimators as est
from riskfeat.models.stack import Scorer, add_score, blend_linear, cross_validate, stack_oof
from riskfeat.operators.evaluate import auc, with_fold


def matrix(spark, rows=400, separable=True, seed=3):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=rows), rng.normal(size=rows)
    y = (x > 0) if separable else (rng.random(rows) > 0.5)
    data = [(i, "test" if i % 7 == 0 else "train", int(y[i]), float(x[i]), float(z[i])) for i in range(rows)]
    df = spark.createDataFrame(data, "id bigint, split string, target int, x double, z double")
    vector = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df)
    return with_fold(vector, "id", 3, 111).cache()


@pytest.fixture(scope="module")
def scorers(spark):
    return [
        Scorer("boost", est.BoostSettings(0.1, 5).estimator()),
        Scorer("log", est.logistic(300), scale=False),
    ]


def test_settings_reach_the_estimators(spark):
    boost = est.BOOST_CATEGORICAL.estimator(features="codes")
    assert (boost.getMaxIter(), boost.getMaxBins(), boost.getMinInstancesPerNode()) == (2000, 200, 5)
    assert boost.getFeatureSubsetStrategy() == "0.7" and boost.getFeaturesCol() == "codes"
    assert est.BOOST_BASE.estimator().getMaxIter() == 800 and est.BOOST_BASE.estimator(4).getMaxIter() == 4
    assert est.forest().getNumTrees() == 1000 and est.forest().getFeatureSubsetStrategy() == "log2"
    assert est.logistic(50).getRegParam() == pytest.approx(0.02)


@pytest.mark.parametrize("separable", [True, False])
def test_scorer_quality(spark, scorers, separable):
    rows = matrix(spark, separable=separable)
    out = cross_validate(rows, scorers[0], 3)
    got = out.collect()
    assert sorted(r.fold for r in got) == [0, 1, 2]
    mean = sum(r.test_auc for r in got) / 3
    assert sum(r.train_auc for r in got) / 3 > mean - 0.05
    assert mean > 0.9 if separable else 0.35 < mean < 0.65


def test_forest(spark):
    rows = matrix(spark)
    model = est.forest(trees=10).fit(rows.where("split = 'train'"))
    out = add_score(rows.where("split = 'test'"), model, "score")
    assert out.columns == rows.columns + ["score"]
    assert auc(out, "target", "score").first().auc > 0.9


def test_logistic_matches_newton(spark):
    rows = matrix(spark).where("split = 'train'")
    data = rows.select("x", "z", "target").toPandas()
    model = est.logistic(len(data)).fit(rows)
    x = np.c_[np.ones(len(data)), data[["x", "z"]].to_numpy()]
    y, w = data["target"].to_numpy(), np.zeros(3)
    penalty = np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (p - y) + penalty @ w
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, gradient)
    assert [model.intercept, *model.coefficients] == pytest.approx(list(w), rel=1e-3, abs=1e-3)


def test_stack_scores_each_row_once_without_its_fold(spark, scorers):
    rows = matrix(spark)
    out = stack_oof(rows, scorers, 3, parallelism=2)
    got = {r.id: r for r in out.collect()}
    assert len(got) == rows.count() == out.count()
    folds = {r.id: (r.split, r.fold) for r in rows.collect()}
    assert all(r.batch == (-1 if folds[i][0] == "test" else folds[i][1]) for i, r in got.items())
    for batch in {r.batch for r in got.values()}:
        scaled = [r.boost for r in got.values() if r.batch == batch]
        assert min(scaled) == 0.0 and max(scaled) == 1.0
    # the unscaled scorer equals a fit made by hand on the other folds
    train = rows.where("split = 'train'")
    by_hand = add_score(train.where("fold = 1"), scorers[1].estimator.fit(train.where("fold <> 1")), "s")
    assert {r.id: pytest.approx(r.s) for r in by_hand.collect()} == {
        i: r["log"] for i, r in got.items() if r.batch == 1}
    full = add_score(rows.where("split = 'test'"), scorers[1].estimator.fit(train), "s")
    assert {r.id: pytest.approx(r.s) for r in full.collect()} == {i: r["log"] for i, r in got.items() if r.batch == -1}


def test_blend_is_least_squares_without_intercept(spark):
    rows = matrix(spark).withColumn("a", F.col("x") + 1).select("id", "split", "target", "a", "z")
    out = blend_linear(rows, ["a", "z"]).toPandas()
    train = out[out.split == "train"]
    weights = np.linalg.lstsq(train[["a", "z"]].to_numpy(), train["target"].to_numpy(), rcond=None)[0]
    assert out["blend"].to_numpy() == pytest.approx(out[["a", "z"]].to_numpy() @ weights)


def test_stack_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    from riskfeat.models import stack
    from riskfeat.models.boosting import Booster
    from riskfeat.session import materialize

    rows = materialize(matrix(spark, 200), partition_by=["split", "fold"])
    scorers = [Scorer("boost", est.BoostSettings(0.1, 3).estimator()), Scorer("own", Booster("pairwise", 0.3, 2, depth=2)), Scorer("log", est.logistic(150))]
    fitted = []
    fit = stack.fit_scorer
    monkeypatch.setattr(stack, "fit_scorer", lambda estimator, rows: fitted.append(rows) or fit(estimator, rows))

    def run(frame=rows, which=scorers):
        fitted.clear()
        out = stack_oof(frame, which, 3, parallelism=2, store=str(tmp_path / "models")).orderBy("id").collect()
        return out, len(fitted)

    first, n = run()
    assert n == 12
    # a fit opens the files of its own folds only
    plan = fitted[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "fold" in plan.split("PartitionFilters: [")[1].split("]")[0]
    again, n = run(rows.repartition(5))
    assert n == 0 and again == first
    # a model that was not written in full, another setting, other rows
    next((tmp_path / "models").glob("*/_DONE")).unlink()
    again, n = run()
    assert n == 1 and [r.id for r in again] == [r.id for r in first]
    assert run(which=[Scorer("boost", est.BoostSettings(0.1, 4).estimator())])[1] == 4
    moved = rows.withColumn("target", F.when(F.col("id") == 2, 1 - F.col("target")).otherwise(F.col("target")))
    fold = rows.where("id = 2").first().fold
    assert run(moved)[1] == 3 * 3 and fold in (0, 1, 2)  # every batch but the one that leaves this fold out
