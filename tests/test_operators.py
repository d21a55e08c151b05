import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T
from pyspark.sql import functions as F

from riskfeat.operators import aggregate as agg
from riskfeat.operators import assemble, encode, evaluate

ANCHOR = datetime(2017, 1, 10)

# Options under which a partition of the small fixtures already counts as skewed.
SMALL_SKEW = {
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "100KB",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "64KB",
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (1, None), (2, None), (3, "a"), (3, "a")], "id int, v string")
    out = agg.per_key(df, "id", {
        "with_null": agg.distinct_count_with_null("v"), "without": agg.distinct_count("v"),
        "rows": agg.row_count(), "filled": agg.value_count("v"), "a": agg.count_where(F.col("v") == "a"),
    })
    got = {r.id: (r.with_null, r["without"], r["rows"], r.filled, r.a) for r in out.collect()}
    assert got == {1: (2, 1, 3, 1, 1), 2: (1, 0, 1, 0, 0), 3: (1, 1, 2, 2, 2)}


def test_latest_time_ignores_missing(spark):
    df = spark.createDataFrame([(1, None), (1, datetime(2017, 1, 1)), (1, datetime(2018, 1, 1))], "id int, t timestamp_ntz")
    assert agg.per_key(df, "id", {"t": F.max("t")}).first().t == datetime(2018, 1, 1)


def around(spark, inclusive=False):
    child = spark.createDataFrame([
        (1, ANCHOR - timedelta(days=1), 5.0), (1, ANCHOR - timedelta(days=2), None), (1, ANCHOR, 100.0),
        (1, ANCHOR + timedelta(days=1), 7.0), (1, ANCHOR + timedelta(days=2), 9.0), (1, None, 50.0),
        (2, ANCHOR, 1.0), (9, ANCHOR, 1.0),
    ], "id int, t timestamp_ntz, amount double")
    people = spark.createDataFrame([(1, ANCHOR), (2, ANCHOR), (3, ANCHOR)], "id int, anchor timestamp_ntz")
    joined = agg.with_anchor(child, people, "id", "anchor")
    out = agg.per_key(joined, "id", agg.before_after("t", "anchor", "amount", before_includes_tie=inclusive))
    return {r.id: tuple(r)[1:] for r in out.collect()}


def test_before_after_ties_in_neither(spark):
    assert around(spark) == {1: (2, 2, 5.0, 8.0, 5.0, 7.0), 2: (0, 0, None, None, None, None)}


def test_before_after_ties_before(spark):
    assert around(spark, True) == {1: (3, 2, 52.5, 8.0, 100.0, 7.0), 2: (1, 0, 1.0, None, 1.0, None)}


def hot_child(spark, rows=120_000, keys=3000):
    """One key holds a third of all rows."""
    i = F.col("id")
    return spark.range(rows).repartition(6).select(
        F.when(i % 3 == 0, F.lit(7)).otherwise(i % keys).alias("id"),
        (F.lit("2017-01-01").cast("timestamp_ntz") + F.make_dt_interval((i % 100).cast("int"))).alias("t"),
        (i % 97).cast("double").alias("amount"), (i % 2003).cast("string").alias("value"),
    )


def test_hot_key_is_split_in_the_join(spark, conf):
    conf(**SMALL_SKEW)
    people = spark.range(3000).select("id", F.lit("2017-02-15").cast("timestamp_ntz").alias("anchor"))
    joined = agg.with_anchor(hot_child(spark), people, "id", "anchor")
    out = agg.per_key(joined, "id", agg.before_after("t", "anchor", "amount"))
    rows = {r.id: r for r in out.collect()}
    assert "skew=true" in plan_of(out)
    # the same from an unfused, unsplit form
    child = hot_child(spark).where(F.col("t") < F.lit("2017-02-15").cast("timestamp_ntz"))
    expected = {r.id: r for r in child.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.avg("amount").alias("m"), F.max("amount").alias("x")).collect()}
    for key, r in expected.items():
        assert (rows[key].n_before, rows[key].max_before) == (r.n, r.x)
        assert rows[key].mean_before == pytest.approx(r.m)


def test_crosstab(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "id int, c string")
    out = agg.per_key(df, "id", agg.crosstab("c", ["x", "y"], "c_")).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, 2, 1), (2, 0, 0)]


def test_membership(spark):
    owner = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p"), (4, None)], "id int, phone string")
    child = spark.createDataFrame([(1, "q"), (1, None), (2, "p"), (2, "p"), (4, None)], "id int, phone string")
    members = assemble.member_keys(owner, child, "id", "phone", "hit")
    assert [tuple(r) for r in members.collect()] == [(2, 1)]


def test_left_star_keeps_rows(spark):
    base = spark.range(10)
    part = spark.createDataFrame([(1, 5)], "id bigint, x int")
    out = assemble.left_star(base, [part, part.withColumnRenamed("x", "y")])
    assert out.count() == 10 and out.where("x = 5 and y = 5").count() == 1


def test_right_join(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (9, "c")], "id int, v string")
    parent = spark.createDataFrame([(1, 10), (2, 20)], "id int, t int")
    out = assemble.right_join(child, parent, "id").select("id", "v", "t").collect()
    assert sorted(map(tuple, out), key=str) == [(1, "a", 10), (1, "b", 10), (2, None, 20)]


def test_right_join_splits_a_hot_key(spark, conf):
    conf(**SMALL_SKEW)
    child = hot_child(spark)
    out = assemble.right_join(child, spark.range(3500), "id")
    alone = 3500 - child.select("id").distinct().count()
    assert alone > 0 and len(out.collect()) == 120_000 + alone
    assert "skew=true" in plan_of(out)


def test_folds_of_extreme_keys(spark):
    df = spark.createDataFrame([(2**63 - 1,), (-(2**63),)], "id bigint")
    got = {r.id: r.fold for r in evaluate.with_fold(df, "id", 5, 111).collect()}
    assert got == {i: (i + 111) % 5 for i in got}


def test_union_and_fill(spark):
    train = spark.createDataFrame([(1, 1, "a", 2.0, ANCHOR)], "id int, target int, c string, x double, t timestamp_ntz")
    test = spark.createDataFrame([(2, None)], "id int, c string")
    out = assemble.fill_zero(assemble.union_split(train, test), skip=("id",)).orderBy("id").collect()
    assert out[0].asDict() == {"id": 1, "target": 1, "c": "a", "x": 2.0, "t": ANCHOR, "split": "train"}
    assert out[1].asDict() == {"id": 2, "target": -1, "c": "0", "x": 0.0, "t": None, "split": "test"}


def test_prefix(spark):
    df = spark.createDataFrame([(1, 2)], "id int, x int")
    assert assemble.prefix_columns(df, "a_").columns == ["id", "a_x"]


# ---- encoders

CATEGORIES = [(1, "b", "x"), (2, "a", None), (3, "c", "x"), (4, None, "y"), (5, "a", "y")]


def test_one_hot(spark):
    df = spark.createDataFrame(CATEGORIES, "id int, c string, d string")
    out = encode.OneHot.fit(df, ["c", "d"]).transform(df).orderBy("id")
    assert out.columns == ["id", "c_a", "c_b", "c_c", "d_x", "d_y"]
    assert [tuple(r)[1:] for r in out.collect()] == [
        (0, 1, 0, 1, 0), (1, 0, 0, 0, 0), (0, 0, 1, 1, 0), (0, 0, 0, 0, 1), (1, 0, 0, 0, 1)]


def test_vocabulary_too_wide(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        encode.fit_vocabulary(df, ["c"], max_values=10)


def test_label_codes(spark):
    df = spark.createDataFrame(CATEGORIES, "id int, c string, d string")
    codes = encode.LabelCodes.fit(df, ["c", "d"])
    out = codes.transform(df).orderBy("id")
    assert out.columns == df.columns
    assert [tuple(r) for r in out.collect()] == [(1, 1, 0), (2, 0, None), (3, 2, 0), (4, None, 1), (5, 0, 1)]
    unseen = spark.createDataFrame([(6, "zz", "x")], "id int, c string, d string")
    assert tuple(codes.transform(unseen).first()) == (6, None, 0)


@pytest.mark.parametrize("n", [10, 1_000, 1_001, 50_000])
def test_label_codes_are_the_same_at_every_size(spark, n):
    df = spark.range(n).select(F.format_string("v%05d", "id").alias("wide"), (F.col("id") % 3).alias("narrow"), "id")
    codes = encode.LabelCodes.fit(df, ["wide", "narrow"])
    plain, marked = codes.transform(df), codes.transform(df, as_category=True)
    assert dict(plain.dtypes) == {"wide": "bigint", "narrow": "bigint", "id": "bigint"}
    assert dict(marked.dtypes) == {"wide": "double", "narrow": "double", "id": "bigint"}
    assert marked.schema["wide"].metadata == {"ml_attr": {"type": "nominal", "name": "wide", "num_vals": n}}
    for out in (plain, marked):
        assert out.where("wide = id and narrow = id % 3").count() == n


AWKWARD = ["1.0", "a", "A", "`", "", " ", "x.y", "a_2", None]


def test_awkward_values_become_columns(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(AWKWARD)], "id int, c string")
    hot = encode.OneHot.fit(df, ["c"])
    out = hot.transform(df)
    assert len({c.lower() for c in out.columns}) == len(AWKWARD)
    names = dict(zip(hot.vocabulary["c"], hot.columns()))
    for r in out.collect():
        value = AWKWARD[r.id]
        assert {n for n in names.values() if r[n]} == ({names[value]} if value is not None else set())
    counts = agg.per_key(df, "id", agg.crosstab("c", hot.vocabulary["c"], "c_"))
    assert sum(sum(tuple(r)[1:]) for r in counts.collect()) == len(AWKWARD) - 1


@pytest.mark.parametrize("values", [AWKWARD, [f"v{i:05d}" for i in range(20_000)], [None]])
def test_one_hot_vectors_take_any_value(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, c string")
    codes = encode.LabelCodes.fit(df, ["c"])
    out = encode.one_hot_vectors(codes.transform(df, as_category=True), codes.sizes, {"c": "hot"})
    assert out.columns == ["id", "c", "hot"]
    rank = {v: i for i, v in enumerate(sorted(v for v in set(values) if v is not None))}
    for r in out.collect():
        place = rank.get(values[r.id])
        assert r.hot.size == max(len(rank), 1)
        assert list(r.hot.indices) == ([] if place is None else [place]) and all(x == 1 for x in r.hot.values)


def test_ranked_values(spark):
    values = [f"v{i:05d}" for i in range(3000)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values * 2], "v string").repartition(7)
    ranked, sizes = encode.ranked_values(df, ["v"])
    got = {r.value: r.code for r in ranked.collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(values)))} and sizes == {"v": 3000}


def rate_inputs(spark):
    events = spark.createDataFrame([
        (1, "A"), (1, "B"), (2, "A"), (3, "B"), (3, None), (4, "A"), (9, "C"), (9, "A"), (8, "C"), (7, None),
    ], "id int, bank string")
    labelled = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 0), (4, 1, 1)], "id int, target int, fold int")
    return events, labelled


def test_label_rates(spark):
    events, labelled = rate_inputs(spark)
    rates = encode.LabelRates.fit(events, labelled, "id", "bank", "target")
    got = {r.id: r.m for r in rates.mean_per_key(events, "id", "m").collect()}
    a, b = 2 / 1.1, 1 / 1.1
    expected = {1: (a + b) / 2, 2: a, 3: b, 4: a, 9: a, 8: None, 7: None}
    assert {k: None if v is None else pytest.approx(v) for k, v in expected.items()} == got


def test_hot_category_is_split_in_a_large_rate_join(spark, conf):
    conf(**SMALL_SKEW)
    i = F.col("id")
    events = spark.range(120_000).repartition(6).select(
        (i % 9000).alias("id"), F.when(i % 3 == 0, "hot").otherwise(F.format_string("b%05d", i % 4000)).alias("bank"))
    labelled = spark.range(9000).select("id", (F.col("id") % 4 == 0).cast("int").alias("target"))
    large = encode.LabelRates.fit(events, labelled, "id", "bank", "target")
    out = large.mean_per_key(events, "id", "m")
    got = {r.id: r.m for r in out.collect()}
    assert "skew=true" in plan_of(out)
    conf(spark__sql__autoBroadcastJoinThreshold="10MB")
    expected = {r.id: r.m for r in large.mean_per_key(events, "id", "m").collect()}
    assert got == pytest.approx(expected)


def test_label_rates_unseen(spark):
    events, labelled = rate_inputs(spark)
    zero = encode.LabelRates.fit(events, labelled, "id", "bank", "target", unseen=0.0)
    got = {r.id: r.m for r in zero.mean_per_key(events, "id", "m").collect()}
    assert got[8] == 0.0 and got[9] == pytest.approx(1 / 1.1) and got[7] is None
    overall = encode.LabelRates.fit(events, labelled, "id", "bank", "target", unseen="global")
    got = {r.id: r.m for r in overall.mean_per_key(events, "id", "m").collect()}
    assert got[8] == pytest.approx(3 / 3.1)


def test_label_rates_out_of_fold(spark):
    events, labelled = rate_inputs(spark)
    rates = encode.LabelRates.fit(events, labelled, "id", "bank", "target", fold="fold", folds=2)
    with_fold = events.join(labelled.select("id", "fold"), "id")
    got = {r.id: r.m for r in rates.mean_per_key(with_fold, "id", "m").collect()}
    # fold 0 = ids 1, 3 is rated from ids 2, 4 and the other way round
    a0, b0, a1, b1 = 1 / 1.1, 0.0, 1 / 0.1, 1 / 1.1
    assert got == {1: pytest.approx((a0 + b0) / 2), 3: pytest.approx(b0), 2: pytest.approx(a1), 4: pytest.approx(a1)}
    assert b1  # bank B of fold 1 has no event to rate


# ---- evaluation

def brute_auc(rows):
    positive = [p for y, p in rows if y == 1]
    negative = [p for y, p in rows if y == 0]
    won = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    return won / (len(positive) * len(negative))


@pytest.mark.parametrize("levels", [1, 3, 40, 10**9])
@pytest.mark.parametrize("buckets", [2, 16])
def test_auc_against_brute_force(spark, levels, buckets):
    rng = random.Random(levels)
    rows = [(int(rng.random() < 0.3), float(rng.randrange(levels))) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, p double")
    got = evaluate.auc(df, "y", "p", buckets=buckets).first().auc
    assert got == pytest.approx(brute_auc(rows))
    mirrored = evaluate.auc(df.withColumn("p", -F.col("p")), "y", "p").first().auc
    assert got == pytest.approx(1 - mirrored)


def test_auc_by_group_and_one_class(spark):
    rows = [(0, 1, 0.9), (0, 0, 0.1), (1, 1, 0.1), (1, 0, 0.9), (2, 1, 0.5)]
    df = spark.createDataFrame(rows, "g int, y int, p double")
    got = {r.g: r.auc for r in evaluate.auc(df, "y", "p", by="g").collect()}
    assert got == {0: 1.0, 1: 0.0, 2: None}


def test_min_max(spark):
    df = spark.createDataFrame([(1, 0.3), (2, 0.3)], "id int, p double")
    assert [r.s for r in evaluate.min_max_scale(df, "p", "s").collect()] == [0.0, 0.0]
    rows = spark.createDataFrame([(0, 1.0, 5.0), (0, 3.0, 5.0), (1, 10.0, 1.0), (1, 20.0, 2.0)], "b int, p double, q double")
    out = evaluate.min_max_scale_by(rows, ["b"], ["p", "q"]).collect()
    assert sorted(map(tuple, out)) == [(0, 0.0, 0.0), (0, 1.0, 0.0), (1, 0.0, 0.0), (1, 1.0, 1.0)]


def test_folds_do_not_depend_on_partitions(spark):
    df = evaluate.with_fold(spark.range(10), "id", 5, 111)
    assert {r.id: r.fold for r in df.repartition(3).collect()} == {i: (i + 111) % 5 for i in range(10)}
    text = evaluate.with_fold(spark.range(1000).select(F.col("id").cast("string").alias("id")), "id", 5, 111)
    sizes = [r["count"] for r in text.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 1000 and min(sizes) > 150


def test_splits(spark):
    df = spark.createDataFrame([(1, datetime(2017, 3, 31, 23)), (2, datetime(2017, 4, 1)), (3, datetime(2016, 5, 1))],
                               "id int, t timestamp_ntz")
    early, late = evaluate.temporal_split(df, "t", "2017-04-01")
    assert ({r.id for r in early.collect()}, {r.id for r in late.collect()}) == ({1, 3}, {2})
    parts = df.select("id", F.year("t").alias("year"), F.month("t").alias("month"))
    early, late = evaluate.year_month_split(parts, 2017, 4)
    assert ({r.id for r in early.collect()}, {r.id for r in late.collect()}) == ({1}, {2})


def test_score_file_by_key(spark):
    people = spark.createDataFrame([(3,), (1,), (2,)], "id int")
    scores = spark.createDataFrame([(1, 0.2), (2, 0.6), (3, 0.4), (4, 9.0)], "id int, s double")
    got = {r.id: r.PROB for r in evaluate.score_file(people, scores, "s").collect()}
    assert got == {1: "0.0000", 2: "1.0000", 3: "0.5000"}


def test_missing_scores_stay_missing(spark):
    df = spark.createDataFrame([(1, None, 0.2), (2, None, None), (3, None, 0.7), (4, "a", 0.5)], "id int, b string, p double")
    assert [r.s for r in evaluate.min_max_scale(df, "p", "s").orderBy("id").collect()][1] is None
    by = {r.id: r.p for r in evaluate.min_max_scale_by(df, ["b"], ["p"]).collect()}
    assert by == {1: 0.0, 2: None, 3: 1.0, 4: 0.0}
    assert {r.id: r.PROB for r in evaluate.format_scores(df, "p").collect()}[2] is None


def test_auc_of_odd_scores(spark):
    rows = [(0, float("-inf")), (0, 0.1), (1, 0.4), (1, float("inf")), (1, float("nan")), (0, None)]
    assert evaluate.auc(spark.createDataFrame(rows, "y int, p double"), "y", "p").first().auc == 1.0


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    import csv

    from riskfeat.sources.scan import scan_csv

    rows = [["1", 'Main "St", 5', "7"], ["2", "two\nlines", "8"], ["3", "", "9"]]
    with open(tmp_path / "a.csv", "w", newline="") as file:
        csv.writer(file).writerows([["id", "region", "n"], *rows])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("region", T.StringType()), T.StructField("n", T.LongType())])
    got = {r.id: (r.region, r.n) for r in scan_csv(spark, str(tmp_path / "a.csv"), schema).collect()}
    assert got == {1: ('Main "St", 5', 7), 2: ("two\nlines", 8), 3: (None, 9)}
