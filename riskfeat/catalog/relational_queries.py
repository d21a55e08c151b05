"""Joins, aggregates, encoders and score post-processing."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskfeat.catalog import driver_tables as src
from riskfeat.catalog.registry import days, query, with_tables
from riskfeat.functions import clean, timefeat
from riskfeat.models.stack import blend_linear
from riskfeat.operators import aggregate as agg
from riskfeat.operators.assemble import left_star, member_keys, prefix_columns, right_join
from riskfeat.operators.encode import (
    LabelCodes,
    LabelRates,
    OneHot,
    assemble_vector,
    fit_vocabulary,
    label_counts,
)
from riskfeat.operators.evaluate import (
    auc,
    min_max_scale,
    min_max_scale_by,
    score_file,
    with_fold,
)
from riskfeat.plans import features as feat


def _round(df, *names):
    """Means are compared to six decimals: the order of addition is free."""
    return df.select([F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


# ---- joins

@query("join_left_star", with_tables("application auth credit user_info", """
SELECT a.id, target, auth.phone, quota, sex FROM application a
LEFT JOIN auth ON a.id = auth.id LEFT JOIN credit c ON a.id = c.id LEFT JOIN user_info u ON a.id = u.id"""))
def _(spark, folder):
    return left_star(src.application(spark, folder).select("id", "target"), [
        src.auth(spark, folder).select("id", "phone"), src.credit(spark, folder).select("id", "quota"),
        src.user(spark, folder).select("id", "sex"),
    ])


@query("join_inner", with_tables("application order_info", """
SELECT a.id, target, type_pay, COUNT(*) AS n FROM application a JOIN order_info o ON a.id = o.id
GROUP BY a.id, target, type_pay"""))
def _(spark, folder):
    joined = src.application(spark, folder).select("id", "target").join(
        src.order(spark, folder).select("id", "type_pay"), "id", "inner"
    )
    return joined.groupBy("id", "target", "type_pay").agg(F.count(F.lit(1)).alias("n"))


@query("join_before_after", with_tables("application cleaned_order", """
SELECT a.id, time_order, amt_order, CASE WHEN time_order < appl_sbm_tm THEN 'before' ELSE 'after' END AS side
FROM cleaned_order o JOIN application a ON o.id = a.id
WHERE time_order < appl_sbm_tm OR time_order > appl_sbm_tm"""))
def _(spark, folder):
    events = feat.order_events(src.order(spark, folder))
    joined = agg.with_anchor(events, src.application(spark, folder), "id", "appl_sbm_tm")
    before = F.col("time_order") < F.col("appl_sbm_tm")
    after = F.col("time_order") > F.col("appl_sbm_tm")
    return joined.where(before | after).select(
        "id", "time_order", "amt_order", F.when(before, "before").otherwise("after").alias("side")
    )


@query("join_right", with_tables("application cleaned_order", """
SELECT a.id, appl_sbm_tm, time_order, amt_order FROM cleaned_order o RIGHT JOIN application a ON o.id = a.id"""))
def _(spark, folder):
    events = feat.order_events(src.order(spark, folder)).select("id", "time_order", "amt_order")
    people = src.application(spark, folder).select("id", "appl_sbm_tm")
    return right_join(events, people, "id").select("id", "appl_sbm_tm", "time_order", "amt_order")


@query("join_prefixed", with_tables("auth user_info", """
SELECT a.id, a.id_card AS auth_id_card, a.phone AS auth_phone, u.id_card AS user_id_card, u.sex AS user_sex
FROM auth a LEFT JOIN user_info u ON a.id = u.id"""))
def _(spark, folder):
    auth = prefix_columns(src.auth(spark, folder).select("id", "id_card", "phone"), "auth_")
    user = prefix_columns(src.user(spark, folder).select("id", "id_card", "sex"), "user_")
    return auth.join(user, "id", "left")


@query("membership_flag", with_tables("application auth bankcard", """
SELECT a.id, CASE WHEN EXISTS (SELECT 1 FROM auth JOIN bankcard b ON auth.id = b.id AND auth.phone = b.phone
  WHERE auth.id = a.id) THEN 1 ELSE 0 END AS exist_phone FROM application a"""))
def _(spark, folder):
    members = member_keys(
        src.auth(spark, folder).select("id", "phone"), src.bankcard(spark, folder), "id", "phone", "exist_phone"
    )
    return src.application(spark, folder).select("id").join(members, "id", "left").select(
        "id", F.coalesce("exist_phone", F.lit(0)).alias("exist_phone")
    )


# ---- aggregates

@query("agg_count_rows", with_tables("bankcard", "SELECT id, COUNT(*) AS bankcard_count FROM bankcard GROUP BY id"))
def _(spark, folder):
    return agg.per_key(src.bankcard(spark, folder), "id", {"bankcard_count": agg.row_count()})


@query("agg_count_nonnull", with_tables("receive", "SELECT id, COUNT(fix_phone) AS fix_phone_count FROM receive GROUP BY id"))
def _(spark, folder):
    return agg.per_key(src.receive(spark, folder), "id", {"fix_phone_count": agg.value_count("fix_phone")})


@query("agg_distinct_with_null", with_tables("bankcard", """
SELECT id, COUNT(DISTINCT bank_name) + MAX(CASE WHEN bank_name IS NULL THEN 1 ELSE 0 END) AS bank_name_len,
  COUNT(DISTINCT tail_num) + MAX(CASE WHEN tail_num IS NULL THEN 1 ELSE 0 END) AS tail_num_len
FROM bankcard GROUP BY id"""))
def _(spark, folder):
    return agg.per_key(src.bankcard(spark, folder), "id", {
        "bank_name_len": agg.distinct_count_with_null("bank_name"),
        "tail_num_len": agg.distinct_count_with_null("tail_num"),
    })


@query("agg_count_if", with_tables("order_info", """
SELECT id, COUNT(*) FILTER (WHERE type_pay = '在线支付') AS type_pay_zaixian,
  COUNT(*) FILTER (WHERE type_pay = '货到付款') AS type_pay_huodao,
  COUNT(*) FILTER (WHERE sts_order = '完成') AS order_many_success FROM order_info GROUP BY id"""))
def _(spark, folder):
    return agg.per_key(src.order(spark, folder), "id", {
        "type_pay_zaixian": agg.count_where(F.col("type_pay") == feat.PAY_ONLINE),
        "type_pay_huodao": agg.count_where(F.col("type_pay") == feat.PAY_ON_DELIVERY),
        "order_many_success": agg.count_where(F.col("sts_order") == feat.ORDER_DONE),
    })


@query("agg_distinct", with_tables("bankcard", "SELECT id, COUNT(DISTINCT phone) AS bank_phone_num FROM bankcard GROUP BY id"))
def _(spark, folder):
    return agg.per_key(src.bankcard(spark, folder), "id", {"bank_phone_num": agg.distinct_count("phone")})


@query("agg_mean", with_tables("cleaned_order", """
SELECT id, round(AVG(amt_order), 6) AS order_mean, round(AVG(unit_price), 6) AS unit_price_mean
FROM cleaned_order GROUP BY id"""))
def _(spark, folder):
    events = feat.order_events(src.order(spark, folder))
    out = agg.per_key(events, "id", {"order_mean": F.avg("amt_order"), "unit_price_mean": F.avg("unit_price")})
    return _round(out, "order_mean", "unit_price_mean")


@query("agg_min_max", with_tables("cleaned_order", """
SELECT id, MAX(amt_order) AS amt_max, MIN(amt_order) AS amt_min FROM cleaned_order GROUP BY id"""))
def _(spark, folder):
    events = feat.order_events(src.order(spark, folder))
    return agg.per_key(events, "id", {"amt_max": F.max("amt_order"), "amt_min": F.min("amt_order")})


@query("agg_first_last_time", with_tables("cleaned_order", """
SELECT id, MAX(time_order) AS order_time_max, MIN(time_order) AS order_time_min FROM cleaned_order GROUP BY id"""))
def _(spark, folder):
    events = feat.order_events(src.order(spark, folder))
    return agg.per_key(events, "id", {"order_time_max": F.max("time_order"), "order_time_min": F.min("time_order")})


@query("recency_days", with_tables("application cleaned_order", f"""
WITH m AS (SELECT id, MAX(time_order) AS t1, MIN(time_order) AS t0 FROM cleaned_order GROUP BY id)
SELECT a.id, {days('appl_sbm_tm', 't1')} AS day_order_max, {days('appl_sbm_tm', 't0')} AS day_order_min
FROM application a JOIN m ON a.id = m.id"""))
def _(spark, folder):
    events = feat.order_events(src.order(spark, folder))
    ends = agg.per_key(events, "id", {"t1": F.max("time_order"), "t0": F.min("time_order")})
    return src.application(spark, folder).join(ends, "id").select(
        "id", timefeat.floor_days("appl_sbm_tm", "t1").alias("day_order_max"),
        timefeat.floor_days("appl_sbm_tm", "t0").alias("day_order_min"),
    )


@query("agg_collect_set", with_tables("bankcard", """
SELECT DISTINCT id, bank_name FROM bankcard WHERE bank_name IS NOT NULL"""))
def _(spark, folder):
    """The set per key as rows, one grain at every size."""
    return agg.value_pairs(src.bankcard(spark, folder), "id", "bank_name")


@query("agg_value_pairs", with_tables("bankcard", "SELECT DISTINCT id, phone FROM bankcard WHERE phone IS NOT NULL"))
def _(spark, folder):
    return agg.value_pairs(src.bankcard(spark, folder), "id", "phone")


REGION_COUNTS = ", ".join(
    f"COUNT(*) FILTER (WHERE region = '{r}') AS region_{r}" for r in ("AF", "AM", "AS", "EU", "MI", "na")
)


@query("crosstab_pivot", with_tables("prefixed_receive", f"SELECT id, {REGION_COUNTS} FROM prefixed_receive GROUP BY id"))
def _(spark, folder):
    receive = src.receive(spark, folder)
    regions = feat.fit_regions(receive)
    return agg.per_key(receive, "id", agg.crosstab(clean.text_prefix("region"), regions, "region_"))


@query("crosstab_label", with_tables("bankcard application", """
SELECT bank_name, COUNT(*) FILTER (WHERE target = 0) AS n0, COUNT(*) FILTER (WHERE target = 1) AS n1
FROM bankcard b JOIN application a ON b.id = a.id WHERE bank_name IS NOT NULL GROUP BY bank_name"""))
def _(spark, folder):
    joined = src.bankcard(spark, folder).join(src.application(spark, folder).select("id", "target"), "id")
    return agg.per_key(joined.where(F.col("bank_name").isNotNull()), "bank_name", label_counts("target"))


def _before_after_sql(amount: str, suffix: str = "", tie: str = "<") -> str:
    return f"""
SELECT a.id, COUNT(*) FILTER (WHERE time_order {tie} appl_sbm_tm) AS n_before{suffix},
  COUNT(*) FILTER (WHERE time_order > appl_sbm_tm) AS n_after{suffix},
  round(AVG({amount}) FILTER (WHERE time_order {tie} appl_sbm_tm), 6) AS mean_before{suffix},
  round(AVG({amount}) FILTER (WHERE time_order > appl_sbm_tm), 6) AS mean_after{suffix},
  MAX({amount}) FILTER (WHERE time_order {tie} appl_sbm_tm) AS max_before{suffix},
  MIN({amount}) FILTER (WHERE time_order > appl_sbm_tm) AS min_after{suffix}
FROM cleaned_order o JOIN application a ON o.id = a.id GROUP BY a.id"""


@query("agg_before_after", with_tables("application cleaned_order", _before_after_sql("amt_order")))
def _(spark, folder):
    out = feat.orders_around_application(feat.order_events(src.order(spark, folder)), src.application(spark, folder))
    return _round(out, "mean_before", "mean_after")


@query("agg_before_after_unit_price", with_tables(
    "application cleaned_order", _before_after_sql("unit_price", "_unit_price")))
def _(spark, folder):
    out = feat.orders_around_application(
        feat.order_events(src.order(spark, folder)), src.application(spark, folder), "unit_price", "_unit_price"
    )
    return _round(out, "mean_before_unit_price", "mean_after_unit_price")


@query("agg_before_after_inclusive", with_tables(
    "application cleaned_order", _before_after_sql("amt_order", tie="<=")))
def _(spark, folder):
    events = feat.order_events(src.order(spark, folder))
    joined = agg.with_anchor(events, src.application(spark, folder), "id", "appl_sbm_tm")
    columns = agg.before_after("time_order", "appl_sbm_tm", "amt_order", before_includes_tie=True)
    return _round(agg.per_key(joined, "id", columns), "mean_before", "mean_after")


@query("agg_unused_order_features", with_tables("cleaned_order", """
SELECT id, round(AVG(unit_price), 6) AS mean_unit_price, round(AVG(amt_order), 6) AS mean_amt_order,
  COUNT(DISTINCT phone) AS order_phone_unique, COUNT(*) FILTER (WHERE sts_order = '完成') AS order_many_success,
  COUNT(sts_order) AS order_many_occur FROM cleaned_order GROUP BY id"""))
def _(spark, folder):
    out = feat.unused_order_history(feat.order_events(src.order(spark, folder)))
    return _round(out, "mean_unit_price", "mean_amt_order")


@query("agg_unused_bankcard_features", with_tables("bankcard", """
SELECT id, COUNT(*) AS bankcard_count,
  COUNT(DISTINCT card_type) + MAX(CASE WHEN card_type IS NULL THEN 1 ELSE 0 END) AS card_type_count,
  COUNT(DISTINCT phone) + MAX(CASE WHEN phone IS NULL THEN 1 ELSE 0 END) AS phone_count
FROM bankcard GROUP BY id"""))
def _(spark, folder):
    return feat.unused_bankcard_counts(src.bankcard(spark, folder))


@query("agg_mapped_score_mean", with_tables("bankcard", """
SELECT id, (COUNT(*) FILTER (WHERE card_type IS DISTINCT FROM '信用卡') * CAST(0.02607069 AS DOUBLE)
  + COUNT(*) FILTER (WHERE card_type = '信用卡') * CAST(0.0154925 AS DOUBLE)) / COUNT(*) AS card_type_score_mean FROM bankcard GROUP BY id"""))
def _(spark, folder):
    score = agg.mapped_mean("card_type", {feat.CREDIT_CARD: feat.CREDIT_CARD_SCORE}, feat.OTHER_CARD_SCORE)
    return agg.per_key(src.bankcard(spark, folder), "id", {"card_type_score_mean": score})


# ---- encoders

def _rate_sql(events: str, category: str, fit_where: str, apply_where: str) -> str:
    return f"""
WITH rates AS (SELECT {category} AS category,
  COUNT(*) FILTER (WHERE target = 1) / (COUNT(*) FILTER (WHERE target = 0) + CAST(0.1 AS DOUBLE)) AS rate
  FROM {events} e JOIN application a ON e.id = a.id WHERE {category} IS NOT NULL AND {fit_where}
  GROUP BY {category})
SELECT e.id, round(AVG(rate), 6) AS rate_mean
FROM {events} e JOIN application a ON e.id = a.id LEFT JOIN rates ON {category} = rates.category
WHERE {apply_where} GROUP BY e.id"""


@query("target_encode", with_tables("application bankcard", _rate_sql("bankcard", "bank_name", "true", "true")))
def _(spark, folder):
    cards = src.bankcard(spark, folder)
    rates = LabelRates.fit(cards, src.application(spark, folder), "id", "bank_name", "target")
    return _round(rates.mean_per_key(cards, "id", "rate_mean"), "rate_mean")


@query("target_encode_region", with_tables(
    "application prefixed_receive", _rate_sql("prefixed_receive", "region", "true", "true")))
def _(spark, folder):
    places = src.receive(spark, folder).withColumn("region", clean.text_prefix("region"))
    rates = LabelRates.fit(places, src.application(spark, folder), "id", "region", "target")
    return _round(rates.mean_per_key(places, "id", "rate_mean"), "rate_mean")


@query("target_encode_apply", with_tables(
    "application bankcard", _rate_sql("bankcard", "bank_name", "split = 'train'", "split = 'test'")))
def _(spark, folder):
    cards, people = src.bankcard(spark, folder), src.application(spark, folder)
    train = people.where(F.col("split") == "train")
    rates = LabelRates.fit(cards, train, "id", "bank_name", "target")
    test_cards = cards.join(people.where(F.col("split") == "test").select("id"), "id")
    return _round(rates.mean_per_key(test_cards, "id", "rate_mean"), "rate_mean")


@query("target_encode_out_of_fold", with_tables("application bankcard", """
WITH rows AS (SELECT b.id, bank_name, target, CAST((b.id + 111) % 5 AS INTEGER) AS fold
  FROM bankcard b JOIN application a ON b.id = a.id),
total AS (SELECT bank_name, COUNT(*) FILTER (WHERE target = 1) AS n1, COUNT(*) FILTER (WHERE target = 0) AS n0
  FROM rows GROUP BY bank_name),
own AS (SELECT bank_name, fold, COUNT(*) FILTER (WHERE target = 1) AS n1,
  COUNT(*) FILTER (WHERE target = 0) AS n0 FROM rows GROUP BY bank_name, fold)
SELECT r.id, round(AVG((t.n1 - o.n1) / (t.n0 - o.n0 + CAST(0.1 AS DOUBLE))), 6) AS rate_mean
FROM rows r LEFT JOIN total t ON r.bank_name = t.bank_name
  LEFT JOIN own o ON r.bank_name = o.bank_name AND r.fold = o.fold GROUP BY r.id"""))
def _(spark, folder):
    people = with_fold(src.application(spark, folder), "id", 5, 111)
    cards = src.bankcard(spark, folder)
    rates = LabelRates.fit(cards, people, "id", "bank_name", "target", fold="fold", folds=5)
    return _round(rates.mean_per_key(with_fold(cards, "id", 5, 111), "id", "rate_mean"), "rate_mean")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("one_hot", with_tables("user_info", """
SELECT id, CASE WHEN coalesce(sex, '0') = '0' THEN 1 ELSE 0 END AS sex_0,
  CASE WHEN sex = '女' THEN 1 ELSE 0 END AS "sex_女", CASE WHEN sex = '男' THEN 1 ELSE 0 END AS "sex_男",
  CASE WHEN coalesce(degree, '0') = '0' THEN 1 ELSE 0 END AS degree_0,
  CASE WHEN degree = '1' THEN 1 ELSE 0 END AS degree_1, CASE WHEN degree = '2' THEN 1 ELSE 0 END AS degree_2,
  CASE WHEN degree = '3' THEN 1 ELSE 0 END AS degree_3 FROM user_info"""))
def _(spark, folder):
    rows = src.user(spark, folder).select(
        "id", *[F.coalesce(c, F.lit("0")).alias(c) for c in ("sex", "degree")]
    )
    return OneHot.fit(rows, ["sex", "degree"]).transform(rows)


@query("label_encode", """
SELECT o_orderkey AS id, DENSE_RANK() OVER (ORDER BY o_orderpriority) - 1 AS priority,
  DENSE_RANK() OVER (ORDER BY o_orderstatus) - 1 AS status FROM orders""")
def _(spark, folder):
    rows = src.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )
    return LabelCodes.fit(rows, ["priority", "status"]).transform(rows)


@query("label_encode_large", """
SELECT c_name AS value, DENSE_RANK() OVER (ORDER BY c_name) - 1 AS code FROM customer""")
def _(spark, folder):
    names = src.table(spark, folder, "customer").select(F.col("c_name").alias("value"), F.col("c_name").alias("code"))
    return LabelCodes.fit(names, ["code"]).transform(names)


@query("fit_vocabulary", """
SELECT DISTINCT 'o_orderpriority' AS name, o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL
UNION ALL SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL""")
def _(spark, folder):
    found = fit_vocabulary(src.table(spark, folder, "orders"), ["o_orderpriority", "o_orderstatus"])
    return spark.createDataFrame([(name, v) for name, values in found.items() for v in values], "name string, value string")


@query("assemble_vector", with_tables("credit", """
SELECT id, coalesce(credit_score, 0) AS f0, coalesce(quota, 0) AS f1, coalesce(overdraft, 0) AS f2 FROM credit"""))
def _(spark, folder):
    rows = src.credit(spark, folder).na.fill(0.0)
    values = vector_to_array("features")
    return assemble_vector(rows.select("id", "credit_score", "quota", "overdraft"), ["id"]).select(
        "id", *[values[i].alias(f"f{i}") for i in range(3)]
    )


# ---- folds, ranking quality, scaling, score file

def labelled_documents(spark, folder):
    """Labelled rows for the scorers: quality against length, language and source."""
    labels = src.table(spark, folder, "labels")
    documents = src.table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "test").otherwise("train").alias("split"),
        F.col("quality").alias("target"), "toxic", F.col("n_chars").cast("double").alias("n_chars"), "lang", "source",
    )


@query("fold_assign", "SELECT o_orderkey AS id, CAST((o_orderkey + 111) % 5 AS INTEGER) AS fold FROM orders")
def _(spark, folder):
    rows = src.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    return with_fold(rows, "id", 5, 111)


def _auc_sql(rows: str) -> str:
    return f"""
WITH x AS ({rows}),
r AS (SELECT y, RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM x)
SELECT round((SUM(CASE WHEN y = 1 THEN rk ELSE 0 END) - SUM(y) * (SUM(y) + 1) / 2)
  / (SUM(y) * (COUNT(*) - SUM(y))), 9) AS auc FROM r"""


@query("auc", _auc_sql("""SELECT CAST(quality AS DOUBLE) AS y, CAST(n_chars AS DOUBLE) AS p
  FROM labels JOIN documents ON labels.doc_id = documents.doc_id"""))
def _(spark, folder):
    out = auc(labelled_documents(spark, folder), "target", "n_chars")
    return _round_auc(out)


@query("auc_many_ties", _auc_sql("""SELECT CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END AS y,
  l_quantity AS p FROM lineitem"""))
def _(spark, folder):
    rows = src.table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("y"), "l_quantity"
    )
    return _round_auc(auc(rows, "y", "l_quantity"))


@query("auc_by_fold", """
WITH x AS (SELECT CAST((l_orderkey + 111) % 5 AS INTEGER) AS fold,
  CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS y, l_extendedprice AS p FROM lineitem),
r AS (SELECT fold, y, RANK() OVER (PARTITION BY fold ORDER BY p)
  + (COUNT(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS rk FROM x)
SELECT fold, round((SUM(CASE WHEN y = 1 THEN rk ELSE 0 END) - SUM(y) * (SUM(y) + 1) / 2)
  / (SUM(y) * (COUNT(*) - SUM(y))), 9) AS auc FROM r GROUP BY fold""")
def _(spark, folder):
    rows = with_fold(src.table(spark, folder, "lineitem"), "l_orderkey", 5, 111).select(
        "fold", F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("y"), "l_extendedprice"
    )
    return _round_auc(auc(rows, "y", "l_extendedprice", by="fold"))


def _round_auc(df):
    return df.withColumn("auc", F.round("auc", 9))


@query("minmax_scale", """
SELECT o_orderkey AS id, round((o_totalprice - MIN(o_totalprice) OVER ())
  / (MAX(o_totalprice) OVER () - MIN(o_totalprice) OVER ()), 6) AS scaled FROM orders""")
def _(spark, folder):
    rows = src.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return _round(min_max_scale(rows, "o_totalprice", "scaled"), "scaled").select("id", "scaled")


@query("minmax_scale_by_fold", """
WITH x AS (SELECT o_orderkey AS id, CAST((o_orderkey + 111) % 5 AS INTEGER) AS fold, o_totalprice AS p FROM orders)
SELECT id, fold, round((p - MIN(p) OVER w) / (MAX(p) OVER w - MIN(p) OVER w), 6) AS p
FROM x WINDOW w AS (PARTITION BY fold)""")
def _(spark, folder):
    rows = src.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p"))
    return _round(min_max_scale_by(with_fold(rows, "id", 5, 111), ["fold"], ["p"]), "p").select("id", "fold", "p")


@query("score_file", with_tables("application", """
WITH s AS (SELECT id, o_totalprice AS p FROM application JOIN orders ON id = o_orderkey WHERE split = 'test')
SELECT id, printf('%.4f', (p - MIN(p) OVER ()) / (MAX(p) OVER () - MIN(p) OVER ())) AS "PROB" FROM s"""))
def _(spark, folder):
    people = src.application(spark, folder).where(F.col("split") == "test")
    scores = src.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p"))
    return score_file(people, scores, "p")


@query("blend_linear", """
WITH x AS (SELECT l.doc_id AS id, CASE WHEN l.doc_id % 7 = 0 THEN 'test' ELSE 'train' END AS split,
  CAST(quality AS DOUBLE) AS y, n_chars / 1000.0 AS a, CAST(toxic AS DOUBLE) AS b
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
s AS (SELECT SUM(a * a) AS aa, SUM(a * b) AS ab, SUM(b * b) AS bb, SUM(a * y) AS ay, SUM(b * y) AS by_
  FROM x WHERE split = 'train')
SELECT id, split, round(a * (ay * bb - by_ * ab) / (aa * bb - ab * ab)
  + b * (by_ * aa - ay * ab) / (aa * bb - ab * ab), 6) AS blend FROM x, s""")
def _(spark, folder):
    rows = labelled_documents(spark, folder).select(
        "id", "split", "target", (F.col("n_chars") / 1000).alias("a"), F.col("toxic").cast("double").alias("b")
    )
    return _round(blend_linear(rows, ["a", "b"]), "blend").select("id", "split", "blend")
