"""Out-of-fold stacking, cross-validation and the linear blend."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfeat.models.boosting import BoostedTrees, Booster
from riskfeat.models.store import ModelStore, fold_digests, settings_of
from riskfeat.models.trees import add_staged_margins, flat
from riskfeat.operators.evaluate import auc, min_max_scale_by
from riskfeat.session import materialize, use_shared_checkpoints

ALL_TRAIN = -1  # batch number of the test rows, scored by a fit on all of train


@dataclass(frozen=True)
class Scorer:
    """A named estimator; its ``featuresCol`` says which matrix it reads."""

    name: str
    estimator: Estimator
    scale: bool = True


def add_score(df: DataFrame, model: Model, name: str) -> DataFrame:
    """Probability of label 1 as a plain column; narrow, no shuffle."""
    scored = model.transform(df)
    added = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn(name, vector_to_array("probability")[1]).drop(*added)


def fit_scorer(estimator: Estimator, rows: DataFrame) -> Model:
    use_shared_checkpoints(rows.sparkSession)
    return estimator.fit(rows)


def _fit_all(jobs: list[tuple], parallelism: int, store: ModelStore | None = None, marks: list[str] | None = None) -> list[Model]:
    """``marks[i]`` tells the rows of job i from others; with a store, a model that is there
    for these settings and rows is taken from it."""
    jobs = [(s, rows, store and store.key(settings_of(s.estimator), mark)) for (s, rows), mark in zip(jobs, marks or [""] * len(jobs))]

    def fit(job):
        scorer, rows, key = job
        model = store.load(key) if store else None
        if model is None:
            model = fit_scorer(scorer.estimator, rows)
            if store:
                store.save(key, model)
        return model

    if parallelism == 1:
        return [fit(job) for job in jobs]
    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(jobs[0][1].sparkSession)(fit), jobs)


def stack_oof(
    matrix: DataFrame, scorers: list[Scorer], folds: int, label: str = "target",
    fold: str = "fold", split: str = "split", keep: tuple[str, ...] = ("id",), parallelism: int = 1,
    store: str | None = None,
) -> DataFrame:
    """One row per applicant with one score per scorer.

    A train row is scored by the fit that did not see its fold, a test row by
    the fit on all of train. Rows of one batch pass through all scorers in one
    chain, so each row is scored once per scorer and nothing is joined. Scores
    are then scaled within (scorer, batch). ``matrix`` should be saved, best by (``split``,
    ``fold``): every fit reads its folds of it. With ``store``, a shared folder, each fitted
    model is kept there at once, and a later run on the same rows fits only what is missing.
    """
    is_train = F.col(split) == "train"
    train = matrix.where(is_train)
    batches = list(range(folds)) + [ALL_TRAIN]
    fit_rows = {b: train if b == ALL_TRAIN else train.where(F.col(fold) != b) for b in batches}
    jobs = [(s, fit_rows[b]) for b in batches for s in scorers]
    marks = None
    if store is not None:
        digests = fold_digests(train, [fold])
        seen = {b: ";".join(f"{k[0]}={v}" for k, v in sorted(digests.items()) if k[0] != b) for b in batches}
        marks = [f"{label};{seen[b]}" for b in batches for _ in scorers]
    models = iter(_fit_all(jobs, parallelism, store and ModelStore(matrix.sparkSession, store), marks))
    parts = []
    for b in batches:
        rows = matrix.where(~is_train) if b == ALL_TRAIN else train.where(F.col(fold) == b)
        for s in scorers:
            rows = add_score(rows, next(models), s.name)
        parts.append(rows.withColumn("batch", F.lit(b)))
    names = [s.name for s in scorers]
    scored = reduce(DataFrame.unionByName, parts).select(*keep, split, label, "batch", *names)
    scaled = [s.name for s in scorers if s.scale]
    # scored once, then read for the ends, the scaling and the blend
    scored = materialize(scored)
    return min_max_scale_by(scored, ["batch"], scaled) if scaled else scored


def cross_validate(
    train: DataFrame, scorer: Scorer, folds: int, label: str = "target", fold: str = "fold",
    parallelism: int = 1,
) -> DataFrame:
    """AUC per fold on the rows the fit has seen and on those it has not."""
    rows = [train.where(F.col(fold) != b) for b in range(folds)]
    models = _fit_all([(scorer, r) for r in rows], parallelism)
    scored = reduce(DataFrame.unionByName, [
        add_score(train, m, "score").select(
            F.lit(b).alias("held_out"), (F.col(fold) == b).alias("unseen"), label, "score"
        )
        for b, m in enumerate(models)
    ])
    each = auc(scored, label, "score", by=["held_out", "unseen"])
    return each.groupBy(F.col("held_out").alias(fold)).agg(
        F.max(F.when(~F.col("unseen"), F.col("auc"))).alias("train_auc"),
        F.max(F.when(F.col("unseen"), F.col("auc"))).alias("test_auc"),
    )


def _staged(df: DataFrame, model: Model, features: str) -> DataFrame:
    """``margins``: the margin after every round."""
    if isinstance(model, BoostedTrees):
        return model.staged(df, "margins")
    return add_staged_margins(df, flat(model), "margins", features=features)


def cross_validate_rounds(
    train: DataFrame, scorer: Scorer, folds: int, label: str = "target", fold: str = "fold",
    parallelism: int = 1, digits: int = 9,
) -> DataFrame:
    """AUC after every boosting round: (round, train_mean, train_std, test_mean, test_std), mean
    and deviation over the folds, on the rows a fit has seen and on those it has not.

    One fit a fold; the margins of all rounds are running sums over its trees, found in one
    pass. Margins that agree to ``digits`` decimals are ties, so the order of sums inside the
    learner decides nothing. Equal margins of a round are counted together before any ranking.
    """
    rows = [train.where(F.col(fold) != b) for b in range(folds)]
    models = _fit_all([(scorer, r) for r in rows], parallelism)
    features = scorer.estimator.features if isinstance(scorer.estimator, Booster) else scorer.estimator.getFeaturesCol()
    staged = reduce(DataFrame.unionByName, [
        _staged(train, m, features).select(
            F.lit(b).alias("held_out"), (F.col(fold) == b).alias("unseen"), F.col(label).alias("label__"),
            F.posexplode("margins").alias("round", "margin"),
        )
        for b, m in enumerate(models)
    ])
    staged = staged.select("held_out", "unseen", "label__", (F.col("round") + 1).alias("round"), F.round("margin", digits).alias("margin"))
    each = auc(staged, "label__", "margin", by=["held_out", "unseen", "round"])
    seen, unseen = (F.when(c, F.col("auc")) for c in (~F.col("unseen"), F.col("unseen")))
    return each.groupBy("round").agg(
        F.avg(seen).alias("train_mean"), F.stddev_pop(seen).alias("train_std"),
        F.avg(unseen).alias("test_mean"), F.stddev_pop(unseen).alias("test_std"),
    )


def blend_linear(
    stacked: DataFrame, scores: list[str], label: str = "target", split: str = "split", name: str = "blend"
) -> DataFrame:
    """Least squares without intercept on train rows, applied to every row."""
    vector = VectorAssembler(inputCols=scores, outputCol="scores").transform(stacked)
    model = LinearRegression(
        featuresCol="scores", labelCol=label, predictionCol=name, fitIntercept=False, regParam=0.0,
        standardization=False, solver="normal",
    ).fit(vector.where(F.col(split) == "train"))
    return model.transform(vector).drop("scores")
