from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from riskfeat.functions import clean, flags, timefeat


def values(spark, texts, expression):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_parse_number(spark):
    got = values(spark, ["12.5", " 7 ", "NA", "null", None, "abc", "nan", "12d", "1e3", "-4"], clean.parse_number("c"))
    assert got == [12.5, 7.0, None, None, None, None, None, None, 1000.0, -4.0]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Shanghai"])
def test_parse_timestamp(spark, conf, zone):
    conf(spark__sql__session__timeZone=zone)
    texts = ["0", "NA", "nan", None, "2017-03-01 10:20:30", "1490000000123", "1490000000", "bad", "2017-03-01",
             "2017-3-1 1:2:3", "10:20", "2017-02-30 10:00:00"]
    got = values(spark, texts, clean.parse_timestamp_multi("c"))
    epoch = datetime(2017, 3, 20, 16, 53, 20)
    assert got == [None, None, None, None, datetime(2017, 3, 1, 10, 20, 30), epoch, epoch, None, None,
                   datetime(2017, 3, 1, 1, 2, 3), None, None]


def test_parse_timestamp_offset(spark):
    got = values(spark, ["1490000000"], clean.parse_timestamp_multi("c", offset_hours=0))
    assert got == [datetime(2017, 3, 20, 8, 53, 20)]


def test_parse_birthday(spark):
    texts = ["1985-1-2", "1985-11-12", "1985-01-02", "1985-2-30", "85后", "--", None, "2001-1-1", "1985-1-2 x", "1985-10-02"]
    strict = values(spark, texts, clean.parse_birthday("c"))
    assert strict == [date(1985, 1, 2), date(1985, 11, 12)] + [None] * 8
    loose = values(spark, texts, clean.parse_birthday("c", reject_zero_padded=False))
    assert loose[2] == date(1985, 1, 2) and loose[9] == date(1985, 10, 2) and loose[3] is None


def test_parse_sentinel_date(spark):
    got = values(spark, ["0000-00-00", "2017-01-02", "2017-01-02 03:04:05", None, "x"], clean.parse_sentinel_date("c"))
    assert got == [None, datetime(2017, 1, 2), datetime(2017, 1, 2, 3, 4, 5), None, None]


def test_text_parts(spark):
    assert values(spark, ["北京市海淀", None, "x"], clean.text_prefix("c")) == ["北京", "na", "x"]
    assert values(spark, ["北京市海淀", None], clean.text_last("c")) == ["淀", "n"]


def test_missing_marks(spark):
    assert values(spark, ["", "NA", "#N/A", "a", None, "0"], clean.nullify("c")) == [None, None, None, "a", None, "0"]


def test_map_category(spark):
    expression = clean.map_category("c", {"a": 1.0, "b": 2.0}, 9.0)
    assert values(spark, ["a", "b", "z", None], expression) == [1.0, 2.0, 9.0, 9.0]


def test_ratio_with_zero_sum(spark):
    df = spark.createDataFrame([(1.0, -0.01), (1.0, 0.99), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(clean.smoothed_ratio("a", "b")).collect()] == [None, 1.0, None]


def test_fixed_decimals(spark):
    df = spark.createDataFrame([(0.12344,), (1.0,), (0.0,)], "a double")
    assert [r[0] for r in df.select(clean.fixed_decimals("a")).collect()] == ["0.1234", "1.0000", "0.0000"]


def test_flags_are_never_null(spark):
    texts = ["--", None, "85后", "0000-00-00"]
    assert values(spark, texts, flags.present("c")) == [1, 0, 1, 1]
    assert values(spark, texts, flags.present_except("c")) == [1, 0, 1, 0]
    assert values(spark, texts, flags.equals("c", "--")) == [1, 0, 0, 0]
    assert values(spark, texts, flags.contains("c", "后")) == [0, 0, 1, 0]


def test_masked_match(spark):
    rows = [(None, None), ("a", None), (None, "a"), ("1..X", "1.X"), ("1..X", "2..X"), ("1..X", "1..Y")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(flags.masked_match_code("a", "b")).collect()] == [0, 1, 2, 3, 4, 4]


def test_null_count(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, None)], "a int, b int, c string")
    assert [r[0] for r in df.select(flags.null_count(["a", "b", "c"])).collect()] == [1, 3]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_floor_days(spark, conf, zone):
    conf(spark__sql__session__timeZone=zone)
    rows = [
        (datetime(2017, 1, 1), datetime(2017, 1, 1, 1)), (datetime(2017, 1, 2), datetime(2017, 1, 1)),
        (datetime(2017, 1, 2, 23, 59, 59), datetime(2017, 1, 1)), (datetime(2017, 3, 13), datetime(2017, 3, 12)),
        (datetime(2016, 3, 1), datetime(2016, 2, 1, 12)), (None, datetime(2017, 1, 1)),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.orderBy("i").select(timefeat.floor_days("a", "b")).collect()]
    assert got == [(a - b).days if a else None for a, b in rows]
    assert got[0] == -1


def test_age(spark):
    df = spark.createDataFrame([(datetime(2017, 1, 1), date(2016, 1, 2))], "a timestamp_ntz, b date")
    assert df.select(timefeat.age_years("a", "b")).first()[0] == 1.0


def test_order_flags(spark):
    anchor = datetime(2017, 1, 10)
    rows = [(1, datetime(2017, 1, 8, 12)), (1, anchor), (1, datetime(2017, 1, 12, 12)), (0, None), (None, None)]
    df = spark.createDataFrame([(i, *r, anchor) for i, r in enumerate(rows)],
                               "i int, known int, event timestamp_ntz, anchor timestamp_ntz")
    columns = timefeat.order_flags("known", "event", "anchor")
    got = df.orderBy("i").select(*[c.alias(n) for n, c in columns.items()]).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, 0), (0, 0, 0, 0), (0, 1, 0, 2), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_date_parts(spark):
    df = spark.createDataFrame([(datetime(2017, 4, 5, 6, 7),)], "t timestamp_ntz")
    parts = timefeat.date_parts("t")
    assert list(parts) == ["hour", "day", "month", "year"]
    assert tuple(df.select(*parts.values()).first()) == (6, 5, 4, 2017)


def test_no_python_in_plans(spark):
    df = spark.range(1).select(F.lit("x").alias("c"))
    plan = df.select(clean.parse_number("c"), clean.parse_timestamp_multi("c"), clean.parse_birthday("c"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
