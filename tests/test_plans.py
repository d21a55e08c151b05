"""What the physical plans must and must not hold, with broadcasts by size switched off."""

import re

import pytest

from riskfeat.catalog import QUERIES
from riskfeat.catalog import flagship_queries as flagship
from riskfeat.operators.evaluate import temporal_split
from riskfeat.session import tune
from riskfeat.sources.scan import scan_features
from riskfeat.sources.sink import write_features


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")


@pytest.mark.parametrize("build", [flagship.wide_features, flagship.anchored_features, flagship.core_features])
def test_feature_plans(spark, data_dir, no_broadcast, build):
    plan = plan_of(build(spark, data_dir))
    for unwanted in ("Python", "Cartesian", "NestedLoop", "SinglePartition", "Window"):
        assert unwanted not in plan
    # every join is an equi join that sorts and merges, or meets a counted fitted table
    assert plan.count("BroadcastExchange") <= 1


def test_children_are_shuffled_once_by_id(spark, data_dir, no_broadcast):
    plan = plan_of(flagship.core_features(spark, data_dir))
    # events and anchors into the inner join, the application into the outer one
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3


@pytest.mark.parametrize("build, exchanges, scans", [(flagship.wide_features, 22, 14), (flagship.anchored_features, 16, 11)])
def test_wide_tables_take_one_pass_over_each_child(spark, data_dir, no_broadcast, build, exchanges, scans):
    plan = plan_of(build(spark, data_dir))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == exchanges and plan.count("FileScan") == scans


def test_scans_read_only_what_is_used(spark, data_dir):
    plan = plan_of(QUERIES["agg_before_after"](spark, data_dir))
    line_items = next(s for s in re.findall(r"ReadSchema: struct<[^>]*", plan) if "l_orderkey" in s)
    assert "l_tax" not in line_items and "l_quantity" not in line_items and "l_shipdate" in line_items


def test_filters_reach_the_scan(spark, data_dir, tmp_path):
    rows = flagship.core_features(spark, data_dir).selectExpr(
        "*", "make_timestamp_ntz(year, month, 1, hour, 0, 0) AS t", "IF(id % 7 = 0, 'test', 'train') AS split")
    write_features(rows, str(tmp_path / "f"))
    late = temporal_split(scan_features(spark, str(tmp_path / "f"), split="train"), "t", "1998-04-01")[1]
    plan = plan_of(late.select("id", "t"))
    assert re.search(r"PartitionFilters: \[[^\]]*split", plan)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(t", plan)


def test_rank_and_scale_use_no_global_window_over_rows(spark, data_dir):
    assert "Window" not in plan_of(QUERIES["minmax_scale"](spark, data_dir))
    plan = plan_of(QUERIES["auc"](spark, data_dir))
    # the one window over everything sits above the bucket totals
    top = plan.index("Window")
    assert "bucket" in plan[top:top + 400] and plan.count("Window [") == 2


@pytest.mark.parametrize("key", ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"])
def test_splits_are_small_unless_the_user_says_otherwise(spark, key):
    """An aggregate of nearly distinct rows holds all of its split, which has to fit in memory."""
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        assert int(tune(spark).conf.get(key).removesuffix("m")) <= 16
        spark.conf.set(key, "64m")
        assert tune(spark).conf.get(key) == "64m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
