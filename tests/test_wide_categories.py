"""Categories and cross-tabs of any number of values, distinct counts without copies of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfeat.catalog import driver_tables as src
from riskfeat.catalog import flagship_queries as flagship
from riskfeat.models import estimators as est
from riskfeat.models.stack import add_score, fit_scorer
from riskfeat.operators import aggregate as agg
from riskfeat.operators.encode import LabelCodes, OutOfFoldRates, assemble_vector, sparse_crosstab
from riskfeat.operators.evaluate import auc, with_fold
from riskfeat.plans import features as feat
from riskfeat.plans import jobs


def test_out_of_fold_rates_by_hand(spark):
    rows = [(0, "a", 1, 0), (1, "a", 1, 1), (2, "a", 0, 1), (3, "b", 0, 0), (4, "b", 0, 1), (5, None, 1, 0), (6, "c", None, -1)]
    df = spark.createDataFrame(rows, "id int, c string, target int, fold int")
    train = df.where("target IS NOT NULL")
    rates = OutOfFoldRates.fit(train, ["c"], folds=2, smooth=2.0)
    got = {r.id: r.c__rate for r in rates.transform(df, F.col("target").isNotNull()).collect()}
    prior = 3 / 6

    def rate(n1, n0):
        return pytest.approx((n1 + 2 * prior) / (n1 + n0 + 2))

    assert got == {0: rate(1, 1), 1: rate(1, 0), 2: rate(1, 0), 3: rate(0, 1), 4: rate(0, 1), 5: prior, 6: prior}
    whole = {r.c: r.c__rate for r in rates.transform(df.select("id", "c", "fold"), F.lit(False)).collect()}
    assert whole["a"] == rate(2, 1) and whole["b"] == rate(0, 2) and whole["a"] > whole["c"] > whole["b"]


def test_fifty_thousand_values_train_with_two_hundred_bins(spark):
    """The values' order is that of their labels, and no row's own label is in its rate."""
    rows = spark.range(100_000).select(
        "id", F.concat(F.lit("v"), F.pmod("id", F.lit(50_000))).alias("c"),
        F.when(F.pmod(F.pmod("id", F.lit(50_000)), F.lit(2)) == 0, 1).otherwise(0).alias("target"), F.lit("train").alias("split"),
    )
    rows = with_fold(rows, "id", 3, 1).cache()
    rates = OutOfFoldRates.fit(rows, ["c"], folds=3)
    ordered = rates.transform(rows, F.lit(True)).select("id", "target", "split", "fold", "c__rate")
    # a value has two rows; where the other is in another fold it tells the label
    means = ordered.groupBy("target").agg(F.avg("c__rate").alias("m")).collect()
    assert dict(means)[1] > dict(means)[0]
    settings = est.BoostSettings(0.3, 3, max_bins=200, column_share=1.0, row_share=1.0)
    matrix = assemble_vector(ordered, ["id", "split", "target", "fold"])
    scored = add_score(matrix, fit_scorer(settings.estimator(), matrix), "s")
    assert auc(scored, "target", "s").first().auc > 0.75


def test_stack_matrix_orders_large_categories(spark, data_dir):
    wide = flagship.wide_features(spark, data_dir)
    wide = wide.withColumn("industry", F.concat(F.lit("i"), F.pmod("id", F.lit(700))))
    rows = jobs.stack_matrix(wide, folds=2)
    attributes = rows.schema["codes"].metadata["ml_attr"]["attrs"]
    assert len(attributes["nominal"]) == 7 and jobs.largest_category(rows) <= 200
    assert [s.estimator.getMaxBins() for s in jobs.stack_scorers(1, jobs.largest_category(rows))] == [32, 32, 32, 200, 32]
    assert rows.count() == wide.count() and {r.fold for r in rows.select("fold").distinct().collect()} == {0, 1}


def test_sparse_crosstab(spark):
    rows = [(1, "b"), (1, "a"), (1, "b"), (2, None), (3, "c"), (9, "a")]
    df = spark.createDataFrame(rows, "id bigint, v string")
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id bigint")
    codes = LabelCodes.fit(df, ["v"])
    out = sparse_crosstab(df, keys, "id", "v", codes, "counts")
    got = {r.id: r.counts for r in out.collect()}
    assert {i: v.toArray().tolist() for i, v in got.items()} == {1: [1, 2, 0], 2: [0, 0, 0], 3: [0, 0, 1], 4: [0, 0, 0]}
    assert out.schema["counts"].metadata["ml_attr"]["num_attrs"] == 3


def test_twenty_thousand_regions(spark, data_dir):
    """The wide table with its regions as one vector, through to a matrix."""
    tables = src.sources(spark, data_dir)
    pair = F.concat(F.chr(F.lit(33) + F.floor(F.col("id") / 150)), F.chr(F.lit(33) + F.pmod("id", F.lit(150))))
    more = spark.range(20_000).select(pair.alias("region"))
    received = tables.receive.select("region").unionByName(more)
    with pytest.raises(ValueError):
        feat.fit_regions(received)
    codes = feat.fit_region_codes(received)
    assert codes.sizes["region"] >= 20_000
    wide = feat.feature_table_wide(tables, [])
    rows = wide.join(feat.region_vectors(tables.receive, tables.application, codes), "id")
    matrix = jobs.one_hot_matrix(rows, jobs.CATEGORIES[jobs.WIDE])
    assert matrix.count() == wide.count() and matrix.first().features.size >= 20_000
    counted = {r.id: sum(r.regions.values) for r in rows.select("id", "regions").collect()}
    want = {r.id: r.n for r in tables.receive.groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert {i: n for i, n in counted.items() if n} == want


def test_value_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), *[None if rng.random() < 0.2 else f"v{rng.integers(4)}" for _ in range(3)]) for k in rng.integers(0, 30, 400)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, c string")
    own = spark.createDataFrame([(i, f"v{i % 5}" if i % 4 else None) for i in range(40)], "id bigint, c string")
    values = agg.ValueRows(df, "id", ["a", "b", "c"], {"c": own})
    out = values.per_key({
        "a": values.distinct_with_null("a"), "b": values.distinct("b"), "c": values.distinct_with_null("c"), "n": values.row_count(),
        "m": values.member("c"), "score": values.mapped_mean("a", {"v1": 2.0}, 5.0), "v2": values.count_of("b", "v2"),
    })
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: tuple(r)[1:] for r in out.collect()}
    want = {}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        asked = f"v{k % 5}" if k % 4 else None
        member = 1 if asked and any(r[3] == asked for r in mine) else None
        want[k] = (
            len({r[1] for r in mine}), len({r[2] for r in mine} - {None}), len({r[3] for r in mine}), len(mine), member,
            pytest.approx(sum(2.0 if r[1] == "v1" else 5.0 for r in mine) / len(mine)), sum(r[2] == "v2" for r in mine),
        )
    assert got == want


@pytest.mark.parametrize("build", [flagship.wide_features, flagship.anchored_features])
def test_feature_tables_copy_no_rows(spark, data_dir, build):
    assert "Expand" not in build(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
