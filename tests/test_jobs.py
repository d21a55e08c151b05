import glob
import os

import pytest
from pyspark.sql import functions as F

from riskfeat.catalog import driver_tables as src
from riskfeat.catalog import flagship_queries as flagship
from riskfeat.models import estimators as est
from riskfeat.plans import features as feat
from riskfeat.plans import jobs
from riskfeat.sources.scan import read_sources, scan_csv
from riskfeat.sources.schema import TABLE_COLUMNS, TEST_FILES, TRAIN_FILES, schema_of


@pytest.fixture(scope="module")
def folders(spark, data_dir, tmp_path_factory):
    """The derived tables as CSV, one folder per split."""
    root = tmp_path_factory.mktemp("raw")
    tables = src.sources(spark, data_dir)
    people = tables.application.select("id", "split")
    for split, files in (("train", TRAIN_FILES), ("test", TEST_FILES)):
        for table in TABLE_COLUMNS:
            df = getattr(tables, table)
            if table == "application":
                df = df.where(F.col("split") == split).drop("split", *(["target"] if split == "test" else []))
                df = df.withColumn("appl_sbm_tm", F.date_format("appl_sbm_tm", "yyyy-MM-dd HH:mm:ss"))
            else:
                df = df.join(people.where(F.col("split") == split).select("id"), "id")
            df.write.option("header", True).csv(str(root / split / files[table]))
    return str(root / "train"), str(root / "test")


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(tuple(repr(round(v, 9) if isinstance(v, float) else v) for v in r) for r in df.select(columns).collect())


def test_csv_and_derived_tables_give_the_same_wide_features(spark, data_dir, folders):
    ours = jobs.build_features(spark, *folders, jobs.WIDE).drop("target")
    theirs = flagship.wide_features(spark, data_dir).drop("target")
    assert ours.columns == theirs.columns
    assert rows_of(ours) == rows_of(theirs)


def test_csv_and_derived_tables_give_the_same_anchored_features(spark, data_dir, folders):
    ours = jobs.build_features(spark, *folders, jobs.ANCHORED).drop("target")
    theirs = flagship.anchored_features(spark, data_dir, None).drop("target")
    assert ours.columns == theirs.columns
    assert rows_of(ours) == rows_of(theirs)


def test_test_rows_are_unlabelled(spark, folders):
    test = read_sources(spark, folders[1], "test").application
    assert {tuple(r) for r in test.select("target", "split").distinct().collect()} == {(-1, "test")}


@pytest.mark.parametrize("stacked", [False, True])
def test_run_writes_scores(spark, folders, tmp_path, stacked, monkeypatch):
    monkeypatch.setattr(est, "STACK_FOLDS", 2)
    if stacked:
        monkeypatch.setattr(jobs, "stack_scorers", lambda rounds, categories: short_scorers(rounds))
    paths = str(tmp_path / "features"), str(tmp_path / "scores")
    jobs.run(spark, *folders, *paths, stacked=stacked, rounds=2)
    assert sorted(os.path.basename(p) for p in glob.glob(paths[0] + "/split=*")) == ["split=test", "split=train"]
    scores = scan_csv(spark, paths[1], schema_of("application").fromDDL("id bigint, PROB string")).collect()
    wanted = {r.id for r in read_sources(spark, folders[1], "test").application.collect()}
    assert {r.id for r in scores} == wanted and len(scores) == len(wanted)
    numbers = [float(r.PROB) for r in scores]
    assert min(numbers) == 0.0 and max(numbers) == 1.0 and all(len(r.PROB) == 6 for r in scores)


def short_scorers(rounds):
    from riskfeat.models.stack import Scorer
    return [Scorer("a", est.BOOST_BASE.estimator(rounds, "onehot")),
            Scorer("b", est.BOOST_CATEGORICAL.estimator(rounds, "codes"))]


def test_stack_matrix_marks_categories(spark, data_dir):
    rows = jobs.stack_matrix(flagship.wide_features(spark, data_dir), folds=2)
    attributes = rows.schema["codes"].metadata["ml_attr"]["attrs"]
    assert len(attributes["nominal"]) == 8 and "numeric" in attributes
    assert jobs.largest_category(rows) == max(a["num_vals"] for a in attributes["nominal"]) > 2
    assert {r.fold for r in rows.select("fold").distinct().collect()} == {0, 1}


def test_id_without_children_is_filled(spark, data_dir):
    tables = src.sources(spark, data_dir)
    lone = tables.application.limit(1).withColumn("id", F.lit(-5).cast("bigint"))
    tables = src.SourceTables(**{**tables.__dict__, "application": lone})
    row = feat.feature_table_wide(tables, ["AF"]).collect()
    assert len(row) == 1
    got = row[0].asDict()
    assert (got["order_time"], got["exist_phone"], got["sex"], got["region_AF"], got["the_same_id"]) == (0, 0, "0", 0, 0)


def test_row_count_never_changes(spark, data_dir):
    wanted = src.application(spark, data_dir).count()
    assert flagship.wide_features(spark, data_dir).count() == wanted
    assert flagship.anchored_features(spark, data_dir, start=None).count() == wanted


def test_csv_scan_tolerates_bad_cells_and_extra_columns(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("extra,quota,id,credit_score\n1,NA,7,600.5\n2,oops,8,\n3,5,x,nan\n")
    out = scan_csv(spark, str(path), schema_of("credit")).collect()
    assert [tuple(r) for r in out] == [(7, 600.5, None, None), (8, None, None, None), (None, None, 5.0, None)]


def test_text_keys(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,quota\nab,1\n")
    assert scan_csv(spark, str(path), schema_of("credit", key_type="string")).first().id == "ab"


def test_validation_of_any_scorer(spark, data_dir):
    """Cross-validation by round and the two splits, on a part of the wide table with few rounds."""
    wide = flagship.wide_features(spark, data_dir).where("id % 3 = 0").cache()
    table = jobs.cross_validate_features(wide, rounds=2, folds=2, parallelism=2).toPandas().sort_values("round")
    assert table["round"].tolist() == [1, 2] and table.train_mean.between(0.4, 1).all() and table.test_std.between(0, 0.5).all()
    for out in (jobs.validate_categorical(wide, flagship.YEAR, flagship.MONTH, rounds=2), jobs.validate_ranking(wide, cut=flagship.CUT, rounds=2)):
        assert 0 <= out.first().auc <= 1
    wide.unpersist()
