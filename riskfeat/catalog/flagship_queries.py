"""The two feature tables in one job each, and the scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfeat.catalog import driver_tables as src
from riskfeat.catalog.registry import days, query, with_tables
from riskfeat.catalog.relational_queries import REGION_COUNTS, labelled_documents
from riskfeat.functions import flags, timefeat
from riskfeat.models import estimators as est
from riskfeat.models.stack import Scorer, add_score, cross_validate, fit_scorer, stack_oof
from riskfeat.operators.assemble import fill_zero, left_star
from riskfeat.operators.encode import LabelCodes, OneHot, assemble_vector
from riskfeat.operators.evaluate import with_fold
from riskfeat.plans import features as feat
from riskfeat.plans import jobs
from riskfeat.session import keep, materialize
from riskfeat.sources.schema import CATEGORIES_NARROW, CATEGORIES_WIDE

# The data reaches back to the nineties, so the cuts are placed inside it.
START = "1997-01-01"
CUT = "1998-04-01"
YEAR, MONTH = 1998, 4

MEANS = ("quota_use_ratio", "how_old", "order_mean", "unit_price_mean", "mean_before", "mean_after",
         "bank_rate_mean")


def rounded(df):
    return df.select([
        F.round(c, 6).alias(c) if c in MEANS else F.col(c)
        for c in df.columns
    ])


def wide_features(spark, folder):
    tables = src.sources(spark, folder)
    # region texts come from the region table, so the vocabulary is fitted there
    names = src.table(spark, folder, "region").select(F.col("r_name").alias("region"))
    regions = sorted(feat.fit_regions(names) + ["na"])
    return feat.feature_table_wide(tables, regions)


def anchored_features(spark, folder, start=START):
    tables = src.sources(spark, folder)
    train = tables.application.where(F.col("split") == "train")
    rates = feat.LabelRates.fit(tables.bankcard, train, "id", "bank_name", "target")
    return feat.feature_table_anchored(tables, rates, start)


@query("features_core", with_tables("application cleaned_order", f"""
WITH b AS (SELECT a.id, COUNT(*) FILTER (WHERE time_order < appl_sbm_tm) AS n_before,
    COUNT(*) FILTER (WHERE time_order > appl_sbm_tm) AS n_after,
    AVG(amt_order) FILTER (WHERE time_order < appl_sbm_tm) AS mean_before,
    AVG(amt_order) FILTER (WHERE time_order > appl_sbm_tm) AS mean_after,
    MAX(amt_order) FILTER (WHERE time_order < appl_sbm_tm) AS max_before,
    MIN(amt_order) FILTER (WHERE time_order > appl_sbm_tm) AS min_after
  FROM cleaned_order o JOIN application a ON o.id = a.id GROUP BY a.id),
e AS (SELECT id, MAX(time_order) AS last_time FROM cleaned_order GROUP BY id)
SELECT a.id, target, coalesce({days('appl_sbm_tm', 'last_time')}, 0) AS day_order_max,
  CAST(hour(appl_sbm_tm) AS INTEGER) AS hour, CAST(month(appl_sbm_tm) AS INTEGER) AS month,
  CAST(year(appl_sbm_tm) AS INTEGER) AS year, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after,
  round(coalesce(mean_before, 0), 6) AS mean_before, round(coalesce(mean_after, 0), 6) AS mean_after,
  coalesce(max_before, 0) AS max_before, coalesce(min_after, 0) AS min_after
FROM application a LEFT JOIN b ON a.id = b.id LEFT JOIN e ON a.id = e.id"""))
def core_features(spark, folder):
    """Orders around the application time, recency and time parts, in one job."""
    events = feat.order_events(src.order(spark, folder))
    people = src.application(spark, folder)
    joined = feat.agg.with_anchor(events, people, "id", "appl_sbm_tm")
    around = feat.agg.before_after("time_order", "appl_sbm_tm", "amt_order")
    history = feat.agg.per_key(joined, "id", {**around, "last_time": F.max("time_order")})
    parts = timefeat.date_parts("appl_sbm_tm", ("hour", "month", "year"))
    out = left_star(people, [history]).select(
        "id", "target", timefeat.floor_days("appl_sbm_tm", "last_time").alias("day_order_max"),
        *[c.alias(n) for n, c in parts.items()], *around,
    )
    return rounded(fill_zero(out, skip=("id", "target")))


def _null_sum(columns) -> str:
    return "CAST(" + " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in columns) + " AS INTEGER)"


def _filled(columns, default) -> str:
    return ", ".join(f"coalesce({c}, {default}) AS {c.split('.')[-1]}" for c in columns)


_RAW_WIDE = (
    "auth_time", "auth.id_card", "auth.phone", "birthday", "hobby", "u.id_card", *CATEGORIES_WIDE,
    "credit_score", "quota", "overdraft", "credit_score", "quota - overdraft", "overdraft / (quota + 0.01)",
)
_BIRTHDAY_FLAGS = ", ".join(
    f"CASE WHEN birthday_text = '{text}' THEN 1 ELSE 0 END AS {name}"
    for name, text in flags.BIRTHDAY_LITERALS.items()
)
_LOOKUP_PARENTS = """
FROM application a LEFT JOIN cleaned_auth auth ON a.id = auth.id LEFT JOIN cleaned_user u ON a.id = u.id
  LEFT JOIN credit c ON a.id = c.id"""


@query("features_m1", with_tables("application cleaned_auth cleaned_user credit bankcard cleaned_order prefixed_receive", f"""
WITH m AS (SELECT DISTINCT auth.id, 1 AS exist_phone FROM auth JOIN bankcard b ON auth.id = b.id AND auth.phone = b.phone),
k AS (SELECT id, COUNT(DISTINCT bank_name) + MAX(CASE WHEN bank_name IS NULL THEN 1 ELSE 0 END) AS bank_name_len,
    COUNT(DISTINCT tail_num) + MAX(CASE WHEN tail_num IS NULL THEN 1 ELSE 0 END) AS tail_num_len,
    COUNT(DISTINCT phone) AS bank_phone_num FROM bankcard GROUP BY id),
o AS (SELECT id, MAX(time_order) AS t1, MIN(time_order) AS t0,
    COUNT(*) FILTER (WHERE type_pay = '在线支付') AS type_pay_zaixian,
    COUNT(*) FILTER (WHERE type_pay = '货到付款') AS type_pay_huodao, COUNT(*) AS order_time,
    AVG(amt_order) AS order_mean, AVG(unit_price) AS unit_price_mean,
    COUNT(DISTINCT time_order) + MAX(CASE WHEN time_order IS NULL THEN 1 ELSE 0 END) AS order_time_set
  FROM cleaned_order GROUP BY id),
r AS (SELECT id, {REGION_COUNTS}, COUNT(fix_phone) AS fix_phone_count, COUNT(DISTINCT fix_phone) AS fix_phone_unique
  FROM prefixed_receive GROUP BY id)
SELECT a.id, split, target, appl_sbm_tm, {_filled(CATEGORIES_WIDE, "'0'")},
  {_filled(("credit_score", "quota", "overdraft"), 0)},
  coalesce(605 - credit_score, 0) AS credit_score_inverse, coalesce(quota - overdraft, 0) AS can_use,
  round(coalesce(overdraft / nullif(quota + CAST(0.01 AS DOUBLE), 0), 0), 6) AS quota_use_ratio,
  CAST(hour(appl_sbm_tm) AS INTEGER) AS hour, CAST(month(appl_sbm_tm) AS INTEGER) AS month,
  CAST(year(appl_sbm_tm) AS INTEGER) AS year, {_null_sum(_RAW_WIDE)} AS nan_num,
  coalesce({days('appl_sbm_tm', 'auth_time')}, 0) AS diff_day,
  round(coalesce({days('appl_sbm_tm', 'CAST(birthday AS TIMESTAMP)')} / 365.0, 0), 6) AS how_old,
  CASE WHEN auth.id_card IS NULL AND u.id_card IS NULL THEN 0 WHEN u.id_card IS NULL THEN 1
    WHEN auth.id_card IS NULL THEN 2
    WHEN left(auth.id_card, 1) = left(u.id_card, 1) AND right(auth.id_card, 1) = right(u.id_card, 1) THEN 3
    ELSE 4 END AS the_same_id,
  {_filled(("exist_phone", "bank_name_len", "tail_num_len", "bank_phone_num", "type_pay_zaixian", "type_pay_huodao"), 0)},
  {_BIRTHDAY_FLAGS}, CASE WHEN contains(birthday_text, '后') THEN 1 ELSE 0 END AS is_hou_in,
  {_filled([f"region_{x}" for x in ("AF", "AM", "AS", "EU", "MI", "na")], 0)},
  {_filled(("fix_phone_count", "fix_phone_unique"), 0)},
  CASE WHEN hobby IS NULL THEN 0 ELSE 1 END AS is_hobby, CASE WHEN u.id_card IS NULL THEN 0 ELSE 1 END AS is_idcard,
  CASE WHEN auth.id_card IS NULL THEN 0 ELSE 1 END AS auth_idcard,
  CASE WHEN auth.phone IS NULL THEN 0 ELSE 1 END AS auth_phone,
  coalesce({days('appl_sbm_tm', 't1')}, 0) AS day_order_max, coalesce({days('appl_sbm_tm', 't0')}, 0) AS day_order_min,
  coalesce(order_time, 0) AS order_time, round(coalesce(order_mean, 0), 6) AS order_mean,
  coalesce(order_time_set, 0) AS order_time_set, round(coalesce(unit_price_mean, 0), 6) AS unit_price_mean
{_LOOKUP_PARENTS} LEFT JOIN m ON a.id = m.id LEFT JOIN k ON a.id = k.id LEFT JOIN o ON a.id = o.id
  LEFT JOIN r ON a.id = r.id"""))
def _(spark, folder):
    return rounded(wide_features(spark, folder))


_RAW_ANCHORED = (
    "auth_time", "auth.id_card", "auth.phone", "auth.id", "auth.id", "auth.id", "birthday", "hobby",
    *CATEGORIES_NARROW, "u.id", "u.id", "credit_score", "quota", "overdraft", "quota - overdraft",
)


@query("features_m2", with_tables("application cleaned_auth cleaned_user credit bankcard cleaned_order", f"""
WITH rates AS (SELECT bank_name, COUNT(*) FILTER (WHERE target = 1)
    / (COUNT(*) FILTER (WHERE target = 0) + CAST(0.1 AS DOUBLE)) AS rate
  FROM bankcard b JOIN application a ON b.id = a.id
  WHERE split = 'train' AND bank_name IS NOT NULL GROUP BY bank_name),
k AS (SELECT id, COUNT(DISTINCT bank_name) + MAX(CASE WHEN bank_name IS NULL THEN 1 ELSE 0 END) AS bank_name_len,
    COUNT(*) AS tail_num_len, COUNT(DISTINCT phone) AS bank_phone_num,
    (COUNT(*) FILTER (WHERE card_type IS DISTINCT FROM '信用卡') * CAST(0.02607069 AS DOUBLE)
      + COUNT(*) FILTER (WHERE card_type = '信用卡') * CAST(0.0154925 AS DOUBLE)) / COUNT(*) AS card_type_score_mean FROM bankcard GROUP BY id),
p AS (SELECT id, AVG(rate) AS bank_rate_mean FROM bankcard LEFT JOIN rates USING (bank_name) GROUP BY id),
o AS (SELECT a.id, COUNT(*) FILTER (WHERE time_order < appl_sbm_tm) AS n_before,
    COUNT(*) FILTER (WHERE time_order > appl_sbm_tm) AS n_after,
    AVG(amt_order) FILTER (WHERE time_order < appl_sbm_tm) AS mean_before,
    AVG(amt_order) FILTER (WHERE time_order > appl_sbm_tm) AS mean_after,
    MAX(amt_order) FILTER (WHERE time_order < appl_sbm_tm) AS max_before,
    MIN(amt_order) FILTER (WHERE time_order > appl_sbm_tm) AS min_after
  FROM cleaned_order e JOIN application a ON e.id = a.id GROUP BY a.id)
SELECT a.id, split, target, appl_sbm_tm, {_filled(CATEGORIES_NARROW, "'0'")},
  CASE WHEN auth_time IS NULL THEN 0 ELSE 1 END AS is_auth_time,
  CASE WHEN auth.id_card IS NULL THEN 0 ELSE 1 END AS is_idcard, CASE WHEN auth.phone IS NULL THEN 0 ELSE 1 END AS is_phone,
  CASE WHEN hobby IS NULL THEN 0 ELSE 1 END AS is_hobby, CASE WHEN birthday_text IS NULL THEN 0 ELSE 1 END AS is_birthday,
  {_filled(("credit_score", "quota", "overdraft"), 0)}, coalesce(quota - overdraft, 0) AS can_use,
  CAST(hour(appl_sbm_tm) AS INTEGER) AS loan_hour, CAST(day(appl_sbm_tm) AS INTEGER) AS loan_day,
  CAST(month(appl_sbm_tm) AS INTEGER) AS loan_month, CAST(year(appl_sbm_tm) AS INTEGER) AS loan_year,
  {_null_sum(_RAW_ANCHORED)} AS nan_num,
  coalesce({days('appl_sbm_tm', 'auth_time')}, 0) AS diff_day,
  coalesce({days('appl_sbm_tm', 'CAST(birthday AS TIMESTAMP)')}, 0) AS how_old,
  CASE WHEN auth_time < appl_sbm_tm THEN 1 ELSE 0 END AS auth_before,
  CASE WHEN auth_time > appl_sbm_tm THEN 1 ELSE 0 END AS auth_after,
  CASE WHEN auth_time < appl_sbm_tm THEN {days('appl_sbm_tm', 'auth_time')} ELSE 0 END AS auth_before_days,
  CASE WHEN auth_time > appl_sbm_tm THEN {days('auth_time', 'appl_sbm_tm')} ELSE 0 END AS auth_after_days,
  {_filled(("bank_name_len", "tail_num_len", "bank_phone_num"), 0)},
  coalesce(card_type_score_mean, 0) AS card_type_score_mean,
  round(coalesce(bank_rate_mean, 0), 6) AS bank_rate_mean, {_filled(("n_before", "n_after"), 0)},
  round(coalesce(mean_before, 0), 6) AS mean_before, round(coalesce(mean_after, 0), 6) AS mean_after,
  {_filled(("max_before", "min_after"), 0)}
{_LOOKUP_PARENTS} LEFT JOIN k ON a.id = k.id LEFT JOIN p ON a.id = p.id LEFT JOIN o ON a.id = o.id
WHERE split = 'test' OR appl_sbm_tm >= TIMESTAMP '{START} 00:00:00'"""))
def _(spark, folder):
    return rounded(anchored_features(spark, folder))


# ---- scorers; learned scores have no SQL form

def _documents(spark, folder):
    return materialize(with_fold(scored_documents(spark, folder), "id", est.STACK_FOLDS, est.STACK_SEED))


DOCUMENT_KEYS = ["id", "split", "target", "fold"]


def scored_documents(spark, folder):
    """All documents: the labelled ones to learn from, the rest and one seventh to score."""
    learnt = labelled_documents(spark, folder).where("split = 'train'").select("id", "target")
    documents = src.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("n_chars"), "lang", "source",
    )
    return documents.join(learnt, "id", "left").select(
        "id", F.when(F.col("target").isNull(), "test").otherwise("train").alias("split"),
        F.coalesce("target", F.lit(-1)).alias("target"), F.coalesce("n_chars", F.lit(0.0)).alias("n_chars"),
        *[F.coalesce(c, F.lit("0")).alias(c) for c in ("lang", "source")],
    )



def _document_matrix(spark, folder, codes=False):
    rows = _documents(spark, folder)
    names = ["lang", "source"]
    encoded = LabelCodes.fit(rows, names).transform(rows, as_category=True) if codes else OneHot.fit(rows, names).transform(rows)
    return keep(assemble_vector(encoded, DOCUMENT_KEYS))


def _train_and_score(matrix, estimator):
    model = fit_scorer(estimator, matrix.where(F.col("split") == "train"))
    return add_score(matrix.where(F.col("split") == "test"), model, "score").select("id", "score")


@query("score_gbt")
def _(spark, folder):
    return _train_and_score(_document_matrix(spark, folder), est.BOOST_BASE.estimator())


@query("score_gbt_categorical")
def _(spark, folder):
    return _train_and_score(_document_matrix(spark, folder, codes=True), est.BOOST_CATEGORICAL.estimator())


@query("score_forest")
def _(spark, folder):
    return _train_and_score(_document_matrix(spark, folder), est.random_cut_forest())


@query("score_logistic")
def _(spark, folder):
    matrix = _document_matrix(spark, folder)
    rows = matrix.where(F.col("split") == "train").count()
    return _train_and_score(matrix, est.logistic(rows))


@query("cross_validate_auc")
def _(spark, folder):
    train = _document_matrix(spark, folder).where(F.col("split") == "train")
    scorer = Scorer("boost", est.BOOST_BASE.estimator(est.CROSS_VALIDATION_ROUNDS))
    return cross_validate(train, scorer, est.CROSS_VALIDATION_FOLDS, parallelism=est.CROSS_VALIDATION_FOLDS)


@query("stack_oof")
def _(spark, folder):
    rows = _documents(spark, folder)
    codes = LabelCodes.fit(rows, ["lang", "source"]).transform(rows, as_category=True)
    coded = assemble_vector(codes, DOCUMENT_KEYS, "codes")
    hot = assemble_vector(OneHot.fit(rows, ["lang", "source"]).transform(rows), DOCUMENT_KEYS, "onehot")
    matrix = keep(hot.join(coded.select("id", "codes"), "id"))
    return stack_oof(matrix, jobs.stack_scorers(), est.STACK_FOLDS, parallelism=4)


@query("score_wide")
def _(spark, folder):
    return jobs.score_single(materialize(wide_features(spark, folder)), jobs.WIDE)


@query("score_anchored")
def _(spark, folder):
    return jobs.score_single(materialize(anchored_features(spark, folder, None)), jobs.ANCHORED, start=START)


@query("validate_wide")
def _(spark, folder):
    return jobs.validate_single(materialize(wide_features(spark, folder)), jobs.WIDE, CUT)


@query("validate_anchored")
def _(spark, folder):
    return jobs.validate_single(materialize(anchored_features(spark, folder, None)), jobs.ANCHORED, CUT)


@query("validate_logistic")
def _(spark, folder):
    return jobs.validate_logistic(materialize(wide_features(spark, folder)), YEAR, MONTH)


@query("score_stacked")
def _(spark, folder):
    return jobs.score_stack(materialize(wide_features(spark, folder)), parallelism=4)
