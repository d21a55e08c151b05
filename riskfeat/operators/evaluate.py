"""Splits in time, ranking quality and score files."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from riskfeat.functions.clean import ColumnOrName, as_col, fixed_decimals
from riskfeat.session import materialize


def temporal_split(df: DataFrame, time: str, cut: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the cut, and rows at or after it."""
    at = F.lit(cut).cast("timestamp_ntz")
    return df.where(F.col(time) < at), df.where(F.col(time) >= at)


def year_month_split(
    df: DataFrame, split_year: int, split_month: int, year: str = "year", month: str = "month"
) -> tuple[DataFrame, DataFrame]:
    """Split on date parts taken one by one.

    The sides do not complement each other: an earlier year with a late month,
    or a later year with an early month, falls in neither.
    """
    y, m = F.col(year), F.col(month)
    return (
        df.where((y <= split_year) & (m < split_month)),
        df.where((y >= split_year) & (m >= split_month)),
    )


def fold_of(key: ColumnOrName, folds: int, seed: int, text: bool = False) -> Column:
    """Fold number from the key alone: stable under any repartitioning or retry."""
    key = as_col(key)
    number = F.xxhash64(key) if text else key.cast("bigint")
    # reduced before the seed is added, so no key can overflow
    return F.pmod(F.pmod(number, F.lit(folds)) + F.lit(seed % folds), F.lit(folds)).cast("int")


def with_fold(df: DataFrame, key: str, folds: int, seed: int, name: str = "fold") -> DataFrame:
    text = isinstance(df.schema[key].dataType, StringType)
    return df.withColumn(name, fold_of(key, folds, seed, text))


def auc(
    df: DataFrame, label: str, score: str, by: str | list[str] | None = None, buckets: int | None = None
) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; one row per ``by``.

    Rows without a score or label, NaN included, do not count; infinite scores rank
    first and last. Equal scores are summed first, so a hot score is one row, and these sums are
    saved, so what is above is read once. Score order is then found bucket by bucket: cut
    points from approximate quantiles of the different scores spread the work and do not affect the result. Only the bucket totals (at most
    ``buckets`` rows per group, by default four per shuffle partition) meet in one window.
    """
    buckets = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = [by] if isinstance(by, str) else list(by or [])
    scored = df.select(
        *groups, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("label")
    ).where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("label").isNotNull())
    probabilities = [i / buckets for i in range(1, buckets)]
    counted = materialize(scored.groupBy(*groups, "score").agg(
        F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg")
    ))
    cuts = sorted({c for c in counted.approxQuantile("score", probabilities, 0.25 / buckets) if math.isfinite(c)})
    if not cuts:
        cuts = [0.0]
    bucketed = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol="score", outputCol="bucket"
    ).transform(counted)
    below = Window.partitionBy(*groups, "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    neg_below = F.coalesce(F.sum("neg").over(below), F.lit(0.0))
    totals = (
        bucketed.withColumn("wins", F.col("pos") * (neg_below + F.col("neg") / 2))
        .groupBy(*groups, "bucket")
        .agg(F.sum("wins").alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    # at most ``buckets`` rows per group from here on
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier_neg = F.coalesce(F.sum("neg").over(earlier), F.lit(0.0))
    won = F.sum(F.col("wins") + F.col("pos") * F.col("earlier_neg"))
    return totals.withColumn("earlier_neg", earlier_neg).groupBy(*groups).agg(
        (won / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc")
    )


def _scaled(c: Column, low: Column, high: Column) -> Column:
    """A missing score stays missing; 0 where all scores are equal."""
    return F.when(c.isNotNull(), F.coalesce((c - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)))


def min_max_scale(df: DataFrame, score: str, name: str) -> DataFrame:
    """``name`` = score scaled to [0, 1] over the whole table; constant scores give 0.
    A missing score stays missing."""
    # one subquery for both ends, which Spark runs once
    ends = df.agg(F.struct(F.min(score).alias("low"), F.max(score).alias("high"))).scalar()
    return df.withColumn(name, _scaled(F.col(score), ends["low"], ends["high"]))


def min_max_scale_by(df: DataFrame, by: list[str], scores: list[str]) -> DataFrame:
    """Each score column scaled within its batch.

    Batches are few (models x folds) while rows are many. The ends are saved, so
    Spark knows their size when it picks the join.
    """
    ends = df.groupBy(*by).agg(*[
        f(s).alias(f"{s}__{n}") for s in scores for n, f in (("low", F.min), ("high", F.max))
    ])
    side = materialize(ends)
    side = side.select(*(F.col(b).alias(f"{b}__batch") for b in by), *(c for c in side.columns if c not in by))
    same = [F.col(b).eqNullSafe(F.col(f"{b}__batch")) for b in by]  # rows without a batch are one batch
    joined = df.join(side, same, "left")
    return joined.select([
        _scaled(F.col(c), F.col(f"{c}__low"), F.col(f"{c}__high")).alias(c) if c in scores else F.col(c)
        for c in df.columns
    ])


def format_scores(scores: DataFrame, score: str, key: str = "id", digits: int = 4) -> DataFrame:
    """``(id, PROB)``: min-max scaled over the table, fixed decimals."""
    return min_max_scale(scores.select(key, score), score, "PROB").select(
        key, fixed_decimals("PROB", digits).alias("PROB")
    )


def score_file(applicants: DataFrame, scores: DataFrame, score: str, key: str = "id", digits: int = 4) -> DataFrame:
    """``format_scores`` for exactly the listed applicants, matched by key."""
    attached = applicants.select(key).join(scores.select(key, score), key, "left")
    return format_scores(attached, score, key, digits)
