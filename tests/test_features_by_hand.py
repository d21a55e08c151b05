"""Both feature tables on hand-made applicants, against values worked out by hand.

1 has everything, 2 has no row in any other table, 3 is a test row with junk, 4 is
a train row before the start of the matrix.
"""

from datetime import date, datetime

import pytest

from riskfeat.plans import features as feat
from riskfeat.sources.schema import SourceTables, schema_of


@pytest.fixture(scope="module")
def tables(spark):
    def make(table, rows, extra=""):
        schema = schema_of(table).add("split", "string") if extra else schema_of(table)
        return spark.createDataFrame(rows, schema)

    return SourceTables(
        application=make("application", [
            (1, datetime(2017, 5, 1, 10, 30), 1, "train"), (2, datetime(2017, 6, 1), 0, "train"),
            (3, datetime(2016, 1, 1), -1, "test"), (4, datetime(2016, 12, 31, 23), 0, "train"),
        ], "split"),
        auth=make("auth", [(1, "2017-04-30 12:00:00", "1..X", "p1"), (3, "0000-00-00", None, "p9")]),
        bankcard=make("bankcard", [
            (1, "A", "信用卡", "p1", "t1"), (1, "A", "储蓄卡", None, "t2"), (1, None, "储蓄卡", "p2", "t2"),
            (3, "B", None, None, None), (4, "A", "信用卡", "p4", "t4"),
        ]),
        credit=make("credit", [(1, 500.0, 100.0, 50.0), (3, None, 10.0, None)]),
        order=make("order", [
            (1, "10", "2", "2017-04-01 00:00:00", "在线支付", "完成", "p1"),
            (1, "NA", "4", "1493654400000", "货到付款", "完成", None),
            (1, "30", "null", "0", None, None, "p1"),
            (3, "5", "1", "2016-01-01 00:00:00", "other", None, None),
        ]),
        receive=make("receive", [(1, "北京市", "f1"), (1, "北京", None), (1, None, "f1"), (3, "上海", None)]),
        user=make("user", [
            (1, "1985-1-2", "h", "1.X", "男", "m", "i", "d", "n", "1", "1", "g"),
            (3, "85后", None, "2.Y", None, "m", "i", "d", "n", "1", "1", None),
        ]),
    )


def test_wide(tables):
    regions = feat.fit_regions(tables.receive)
    assert regions == ["na", "上海", "北京"]
    got = {r.id: r.asDict() for r in feat.feature_table_wide(tables, regions).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    full = {
        "sex": "男", "credit_score": 500.0, "credit_score_inverse": 105.0, "can_use": 50.0,
        "quota_use_ratio": pytest.approx(50 / 100.01), "hour": 10, "month": 5, "year": 2017, "nan_num": 0,
        "diff_day": 0, "how_old": pytest.approx((date(2017, 5, 1) - date(1985, 1, 2)).days / 365),
        "the_same_id": 3, "exist_phone": 1, "bank_name_len": 2, "tail_num_len": 2, "bank_phone_num": 2,
        "type_pay_zaixian": 1, "type_pay_huodao": 1, "is_double_": 0, "is_hou_in": 0, "region_北京": 2,
        "region_na": 1, "region_上海": 0, "fix_phone_count": 2, "fix_phone_unique": 1, "is_hobby": 1,
        "is_idcard": 1, "auth_idcard": 1, "auth_phone": 1, "day_order_max": -1, "day_order_min": 30,
        "order_time": 3, "order_mean": 20.0, "order_time_set": 3, "unit_price_mean": 3.0, "target": 1,
    }
    assert {k: got[1][k] for k in full} == full
    # nothing known: three, three, eight, five and one missing cells; all features 0
    assert got[2]["nan_num"] == 20
    rest = {k: v for k, v in got[2].items() if k not in (*feat.KEYS, "nan_num", "month", "year")}
    assert set(rest.values()) <= {0, 0.0, "0"}
    junk = {
        # time, card, birthday, hobby, sex, grade, score and its inverse, overdraft, can_use, ratio
        "nan_num": 11, "diff_day": 0, "how_old": 0.0, "the_same_id": 2, "exist_phone": 0, "bank_name_len": 1,
        "tail_num_len": 1, "bank_phone_num": 0, "is_hou_in": 1, "is_hobby": 0, "is_idcard": 1,
        "auth_idcard": 0, "auth_phone": 1, "day_order_max": 0, "order_time_set": 1, "region_上海": 1,
        "fix_phone_count": 0, "type_pay_zaixian": 0, "quota": 10.0, "can_use": 0.0, "target": -1, "split": "test",
    }
    assert {k: got[3][k] for k in junk} == junk


def test_anchored(tables):
    train = SourceTables(**{**tables.__dict__, "application": tables.application.where("split = 'train'")})
    rates = feat.fit_bank_rates(train)
    out = feat.feature_table_anchored(tables, rates, start=None)
    got = {r.id: r.asDict() for r in out.collect()}
    # the scoring step leaves the early train row out, the early test row stays
    assert len(got) == 4
    assert sorted(r.id for r in feat.since(out, feat.MATRIX_START).collect()) == [1, 2, 3]
    full = {
        "is_auth_time": 1, "is_idcard": 1, "is_phone": 1, "is_hobby": 1, "is_birthday": 1, "can_use": 50.0,
        "loan_hour": 10, "loan_day": 1, "loan_month": 5, "loan_year": 2017, "nan_num": 0, "diff_day": 0,
        "how_old": (date(2017, 5, 1) - date(1985, 1, 2)).days, "auth_before": 1, "auth_after": 0,
        "auth_before_days": 0, "auth_after_days": 0, "bank_name_len": 2, "tail_num_len": 3, "bank_phone_num": 2,
        "card_type_score_mean": pytest.approx((0.0154925 + 2 * 0.02607069) / 3),
        # bank A: two cards of a defaulter, one of a payer, left out of the matrix but not of the rates
        "bank_rate_mean": pytest.approx(2 / 1.1),
        "n_before": 1, "n_after": 1, "mean_before": 10.0, "mean_after": 0.0, "max_before": 10.0, "min_after": 0.0,
    }
    assert {k: got[1][k] for k in full} == full
    assert got[2]["nan_num"] == 18 and got[2]["auth_before"] == 0 and got[2]["sex"] == "0"
    junk = {
        # time, card, birthday, hobby, sex, grade, score, overdraft, can_use
        "nan_num": 9, "is_auth_time": 0, "is_idcard": 0, "is_phone": 1, "is_birthday": 1, "auth_before": 0,
        "card_type_score_mean": pytest.approx(0.02607069), "bank_rate_mean": 0.0,
        # the order is at the very time of the application
        "n_before": 0, "n_after": 0, "tail_num_len": 1,
    }
    assert {k: got[3][k] for k in junk} == junk


def test_unused_features(tables):
    got = {r.id: tuple(r)[1:] for r in feat.unused_order_history(feat.order_events(tables.order)).collect()}
    assert got == {1: (3.0, 20.0, 1, 2, 2), 3: (1.0, 5.0, 0, 0, 0)}
    got = {r.id: tuple(r)[1:] for r in feat.unused_bankcard_counts(tables.bankcard).collect()}
    assert got == {1: (3, 2, 3), 3: (1, 1, 1), 4: (1, 1, 1)}
