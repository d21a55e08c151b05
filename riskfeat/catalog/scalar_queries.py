"""Scans, sinks, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfeat.catalog import driver_tables as src
from riskfeat.catalog.registry import AMOUNT, AUTH_TIME, BIRTHDAY, ORDER_TIME, days, query, with_tables
from riskfeat.functions import clean, flags, timefeat
from riskfeat.operators.assemble import fill_zero, union_split
from riskfeat.operators.evaluate import temporal_split, year_month_split
from riskfeat.session import scratch_path
from riskfeat.sources.scan import scan_csv, scan_features, scan_parquet, scan_rejected
from riskfeat.sources.schema import schema_of
from riskfeat.sources.sink import write_features, write_scores

CUT = "1998-04-01 00:00:00"


# ---- scans and sinks

@query("scan_table", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def _(spark, folder):
    return scan_parquet(spark, f"{folder}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"
    )


@query("scan_csv", with_tables("bankcard", """
SELECT id, bank_name, card_type, phone, tail_num FROM bankcard"""))
def _(spark, folder):
    path = scratch_path(spark, "bankcard")
    # missing cells go out as a mark and must come back as NULL
    text = src.bankcard(spark, folder)
    marked = text.select("id", *[F.coalesce(c, F.lit("NA")).alias(c) for c in text.columns[1:]])
    write_scores(marked, path)
    return scan_csv(spark, path, schema_of("bankcard"))


@query("scan_csv_line_breaks", """
SELECT doc_id, nullif(text, '') AS text, source FROM documents WHERE doc_id % 10 <> 3""")
def _(spark, folder):
    """Texts with line breaks, commas and quotes in CSV files, as many as tasks write, cut into
    records in parallel; every tenth key is no number, so those rows are left out here."""
    path = scratch_path(spark, "documents")
    rows = src.table(spark, folder, "documents").select(
        F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("x"), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string")).alias("doc_id"),
        "source", "text",
    )
    rows.write.options(header=True, quoteAll=True, quote='"', escape='"').csv(path)
    schema = T.StructType.fromDDL("doc_id bigint, text string, source string")
    return scan_csv(spark, path, schema).where("doc_id IS NOT NULL")


@query("scan_csv_rejected", """
SELECT 'x' || doc_id || ',' || source AS record FROM documents WHERE doc_id % 10 = 3""")
def _(spark, folder):
    """The records whose key does not parse, apart from the others."""
    path = scratch_path(spark, "documents")
    key = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("x"), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string"))
    write_scores(src.table(spark, folder, "documents").select(key.alias("doc_id"), "source"), path)
    return scan_rejected(spark, path, T.StructType.fromDDL("doc_id bigint, source string"), key="doc_id")


@query("scan_parse_dates", with_tables("application", """
SELECT id, appl_sbm_tm, target FROM application"""))
def _(spark, folder):
    path = scratch_path(spark, "application")
    rows = src.application(spark, folder)
    write_scores(rows.withColumn("appl_sbm_tm", F.col("appl_sbm_tm").cast("string")), path)
    return scan_csv(spark, path, schema_of("application"))


@query("scan_features", with_tables("credit", """
SELECT id, coalesce(credit_score, 0) AS credit_score, coalesce(quota, 0) AS quota,
  coalesce(overdraft, 0) AS overdraft FROM credit"""))
def _(spark, folder):
    path = scratch_path(spark, "credit")
    write_features(src.credit(spark, folder), path, partition_by=None)
    return scan_features(spark, path)


@query("sink_features_roundtrip", with_tables("application credit", """
SELECT a.id, split, target, coalesce(quota, 0) AS quota
FROM application a LEFT JOIN credit c ON a.id = c.id"""))
def _(spark, folder):
    path = scratch_path(spark, "features")
    rows = src.application(spark, folder).select("id", "split", "target").join(
        src.credit(spark, folder).select("id", "quota"), "id", "left"
    )
    write_features(rows, path)
    parts = [scan_features(spark, path, split=s).select("id", "split", "target", "quota") for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query("sink_scores_roundtrip", "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS \"PROB\" FROM orders")
def _(spark, folder):
    path = scratch_path(spark, "scores")
    rows = src.table(spark, folder, "orders")
    write_scores(rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("PROB")), path)
    return spark.read.schema("id bigint, PROB string").option("header", True).csv(path)


# ---- projections, filters, splits

@query("project", with_tables("user_info", "SELECT id, birthday FROM user_info"))
def _(spark, folder):
    return src.user(spark, folder).select("id", "birthday")


@query("derive_diff", with_tables("credit", "SELECT id, quota - overdraft AS can_use FROM credit"))
def _(spark, folder):
    return src.credit(spark, folder).select("id", clean.difference("quota", "overdraft").alias("can_use"))


@query("derive_inverse", with_tables("credit", "SELECT id, 605 - credit_score AS credit_score_inverse FROM credit"))
def _(spark, folder):
    return src.credit(spark, folder).select("id", clean.inverted("credit_score").alias("credit_score_inverse"))


@query("derive_ratio", with_tables("credit", """
SELECT id, round(overdraft / nullif(quota + CAST(0.01 AS DOUBLE), 0), 6) AS quota_use_ratio FROM credit"""))
def _(spark, folder):
    ratio = F.round(clean.smoothed_ratio("overdraft", "quota"), 6)
    return src.credit(spark, folder).select("id", ratio.alias("quota_use_ratio"))


@query("drop_columns", with_tables("user_info", """
SELECT id, sex, qq_bound, wechat_bound, account_grade, hobby, birthday FROM user_info"""))
def _(spark, folder):
    return src.user(spark, folder).drop("merriage", "income", "id_card", "degree", "industry")


@query("union_split", with_tables("application credit", """
WITH j AS (SELECT a.id, split, target, quota, overdraft FROM application a LEFT JOIN credit c ON a.id = c.id)
SELECT id, split, target, coalesce(quota, 0) AS quota, coalesce(overdraft, 0) AS overdraft
FROM j WHERE split = 'train'
UNION ALL SELECT id, split, -1, coalesce(quota, 0), 0 FROM j WHERE split = 'test'"""))
def _(spark, folder):
    rows = src.application(spark, folder).drop("appl_sbm_tm").join(src.credit(spark, folder).drop("credit_score"), "id", "left")
    train = rows.where(F.col("split") == "train").drop("split")
    # the test side lacks the label and one feature
    test = rows.where(F.col("split") == "test").drop("split", "target", "overdraft")
    return fill_zero(union_split(train, test))


@query("filter_cutoff", with_tables("application", f"""
SELECT id, appl_sbm_tm FROM application WHERE appl_sbm_tm >= TIMESTAMP '{CUT}'"""))
def _(spark, folder):
    return temporal_split(src.application(spark, folder), "appl_sbm_tm", CUT)[1].select("id", "appl_sbm_tm")


@query("temporal_split", with_tables("application", f"""
SELECT id, CASE WHEN appl_sbm_tm < TIMESTAMP '{CUT}' THEN 'early' ELSE 'late' END AS side
FROM application"""))
def _(spark, folder):
    early, late = temporal_split(src.application(spark, folder), "appl_sbm_tm", CUT)
    return early.select("id", F.lit("early").alias("side")).unionByName(
        late.select("id", F.lit("late").alias("side"))
    )


@query("split_year_month", with_tables("application", """
WITH p AS (SELECT id, CAST(year(appl_sbm_tm) AS INTEGER) AS year,
  CAST(month(appl_sbm_tm) AS INTEGER) AS month FROM application)
SELECT id, year, month, 'early' AS side FROM p WHERE year <= 1998 AND month < 4
UNION ALL SELECT id, year, month, 'late' FROM p WHERE year >= 1998 AND month >= 4"""))
def _(spark, folder):
    parts = timefeat.date_parts("appl_sbm_tm", ("year", "month"))
    rows = src.application(spark, folder).select("id", *[c.alias(n) for n, c in parts.items()])
    early, late = year_month_split(rows, 1998, 4)
    return early.withColumn("side", F.lit("early")).unionByName(late.withColumn("side", F.lit("late")))


# ---- flags and text

@query("flag_present", with_tables("auth", """
SELECT id, CASE WHEN id_card IS NULL THEN 0 ELSE 1 END AS auth_idcard,
  CASE WHEN phone IS NULL THEN 0 ELSE 1 END AS auth_phone FROM auth"""))
def _(spark, folder):
    return src.auth(spark, folder).select(
        "id", flags.present("id_card").alias("auth_idcard"), flags.present("phone").alias("auth_phone")
    )


@query("flag_present_sentinel", with_tables("auth", """
SELECT id, CASE WHEN auth_time IS NULL OR auth_time = '0000-00-00' THEN 0 ELSE 1 END AS is_auth_time FROM auth"""))
def _(spark, folder):
    return src.auth(spark, folder).select("id", flags.present_except("auth_time").alias("is_auth_time"))


@query("flag_equals", with_tables("user_info", """
SELECT id, CASE WHEN birthday = '--' THEN 1 ELSE 0 END AS is_double_,
  CASE WHEN birthday = '0-0-0' THEN 1 ELSE 0 END AS is_0_0_0,
  CASE WHEN birthday = '1-1-1' THEN 1 ELSE 0 END AS is_1_1_1,
  CASE WHEN birthday = '0000-00-00' THEN 1 ELSE 0 END AS is_0000_00_00,
  CASE WHEN birthday = '0001-1-1' THEN 1 ELSE 0 END AS is_0001_1_1 FROM user_info"""))
def _(spark, folder):
    return src.user(spark, folder).select(
        "id", *[flags.equals("birthday", text).alias(name) for name, text in flags.BIRTHDAY_LITERALS.items()]
    )


@query("flag_contains", with_tables("user_info", """
SELECT id, CASE WHEN contains(birthday, '后') THEN 1 ELSE 0 END AS is_hou_in FROM user_info"""))
def _(spark, folder):
    return src.user(spark, folder).select(
        "id", flags.contains("birthday", flags.BIRTHDAY_DECADE_MARK).alias("is_hou_in")
    )


@query("str_prefix_suffix", with_tables("receive", """
SELECT coalesce(substr(region, 1, 2), 'na') AS first_name, coalesce(right(region, 1), 'n') AS last_name,
  COUNT(*) AS n FROM receive GROUP BY 1, 2"""))
def _(spark, folder):
    named = src.receive(spark, folder).select(
        clean.text_prefix("region").alias("first_name"), clean.text_last("region").alias("last_name")
    )
    return named.groupBy("first_name", "last_name").agg(F.count(F.lit(1)).alias("n"))


@query("masked_id_match", with_tables("auth user_info", """
SELECT a.id, CASE
  WHEN a.id_card IS NULL AND u.id_card IS NULL THEN 0
  WHEN u.id_card IS NULL THEN 1 WHEN a.id_card IS NULL THEN 2
  WHEN left(a.id_card, 1) || right(a.id_card, 1) = left(u.id_card, 1) || right(u.id_card, 1) THEN 3
  ELSE 4 END AS the_same_id
FROM auth a LEFT JOIN user_info u ON a.id = u.id"""))
def _(spark, folder):
    users = src.user(spark, folder).select("id", F.col("id_card").alias("user_id_card"))
    return src.auth(spark, folder).join(users, "id", "left").select(
        "id", flags.masked_match_code("id_card", "user_id_card").alias("the_same_id")
    )


@query("row_null_count", with_tables("user_info", """
SELECT id, CAST((CASE WHEN birthday IS NULL THEN 1 ELSE 0 END) + (CASE WHEN hobby IS NULL THEN 1 ELSE 0 END)
  + (CASE WHEN id_card IS NULL THEN 1 ELSE 0 END) + (CASE WHEN sex IS NULL THEN 1 ELSE 0 END)
  + (CASE WHEN income IS NULL THEN 1 ELSE 0 END) + (CASE WHEN degree IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS nan_num
FROM user_info"""))
def _(spark, folder):
    columns = ["birthday", "hobby", "id_card", "sex", "income", "degree"]
    return src.user(spark, folder).select("id", flags.null_count(columns).alias("nan_num"))


@query("fill_zero", with_tables("user_info credit", """
SELECT u.id, coalesce(sex, '0') AS sex, coalesce(income, '0') AS income, coalesce(quota, 0) AS quota
FROM user_info u LEFT JOIN credit c ON u.id = c.id"""))
def _(spark, folder):
    rows = src.user(spark, folder).select("id", "sex", "income")
    return fill_zero(rows.join(src.credit(spark, folder).select("id", "quota"), "id", "left"))


@query("format_prob", "SELECT c_custkey AS id, printf('%.4f', c_acctbal / 7) AS \"PROB\" FROM customer")
def _(spark, folder):
    return src.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), clean.fixed_decimals(F.col("c_acctbal") / 7).alias("PROB")
    )


# ---- dirty numbers and times

@query("parse_number", with_tables("order_info", f"""
SELECT id, amt_order AS raw, {AMOUNT.format(c='amt_order')} AS amount FROM order_info"""))
def _(spark, folder):
    return src.order(spark, folder).select(
        "id", F.col("amt_order").alias("raw"), clean.parse_number("amt_order").alias("amount")
    )


@query("parse_timestamp_multi", with_tables("order_info", f"""
SELECT id, time_order AS raw, {ORDER_TIME} AS time_order FROM order_info"""))
def _(spark, folder):
    return src.order(spark, folder).select(
        "id", F.col("time_order").alias("raw"), clean.parse_timestamp_multi("time_order").alias("time_order")
    )


@query("parse_birthday", with_tables("user_info", f"""
SELECT id, birthday AS raw, CAST({BIRTHDAY} AS VARCHAR) AS birthday FROM user_info"""))
def _(spark, folder):
    return src.user(spark, folder).select(
        "id", F.col("birthday").alias("raw"), clean.parse_birthday("birthday").cast("string").alias("birthday")
    )


@query("parse_sentinel_date", with_tables("auth", f"SELECT id, {AUTH_TIME} AS auth_time FROM auth"))
def _(spark, folder):
    return src.auth(spark, folder).select("id", clean.parse_sentinel_date("auth_time").alias("auth_time"))


@query("date_parts", with_tables("application", """
SELECT id, CAST(hour(appl_sbm_tm) AS INTEGER) AS loan_hour, CAST(day(appl_sbm_tm) AS INTEGER) AS loan_day,
  CAST(month(appl_sbm_tm) AS INTEGER) AS loan_month, CAST(year(appl_sbm_tm) AS INTEGER) AS loan_year
FROM application"""))
def _(spark, folder):
    parts = timefeat.date_parts("appl_sbm_tm", prefix="loan_")
    return src.application(spark, folder).select("id", *[c.alias(n) for n, c in parts.items()])


@query("floor_days", f"""
SELECT event_id AS id, {days('ts', "TIMESTAMP '2024-01-15 00:00:00'")} AS days FROM events""")
def _(spark, folder):
    anchor = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return src.table(spark, folder, "events").select(
        F.col("event_id").alias("id"), timefeat.floor_days("ts", anchor).alias("days")
    )


@query("age_years", with_tables("application cleaned_user", f"""
SELECT a.id, round({days('appl_sbm_tm', 'CAST(birthday AS TIMESTAMP)')} / 365.0, 6) AS how_old
FROM application a JOIN cleaned_user u ON a.id = u.id"""))
def _(spark, folder):
    users = src.user(spark, folder).select("id", clean.parse_birthday("birthday").alias("birthday"))
    return src.application(spark, folder).join(users, "id").select(
        "id", F.round(timefeat.age_years("appl_sbm_tm", "birthday"), 6).alias("how_old")
    )


def _around(spark, folder):
    auth = src.auth(spark, folder).select(
        "id", flags.present_except("auth_time").alias("known"),
        clean.parse_sentinel_date("auth_time").alias("auth_time"),
    )
    joined = src.application(spark, folder).join(auth, "id", "left")
    return joined, timefeat.order_flags("known", "auth_time", "appl_sbm_tm")


@query("time_order_flags", with_tables("application cleaned_auth", """
SELECT a.id, CASE WHEN auth_time < appl_sbm_tm THEN 1 ELSE 0 END AS auth_before,
  CASE WHEN auth_time > appl_sbm_tm THEN 1 ELSE 0 END AS auth_after
FROM application a LEFT JOIN cleaned_auth c ON a.id = c.id"""))
def _(spark, folder):
    joined, around = _around(spark, folder)
    return joined.select("id", around["before"].alias("auth_before"), around["after"].alias("auth_after"))


@query("time_order_days", with_tables("application cleaned_auth", f"""
SELECT a.id,
  CASE WHEN auth_time < appl_sbm_tm THEN {days('appl_sbm_tm', 'auth_time')} ELSE 0 END AS auth_before_days,
  CASE WHEN auth_time > appl_sbm_tm THEN {days('auth_time', 'appl_sbm_tm')} ELSE 0 END AS auth_after_days
FROM application a LEFT JOIN cleaned_auth c ON a.id = c.id"""))
def _(spark, folder):
    joined, around = _around(spark, folder)
    return joined.select(
        "id", around["before_days"].alias("auth_before_days"), around["after_days"].alias("auth_after_days")
    )
