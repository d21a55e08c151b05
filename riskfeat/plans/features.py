"""The two wide feature tables, each for any split by the same code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.functions import clean, flags, timefeat
from riskfeat.operators import aggregate as agg
from riskfeat.operators.assemble import fill_zero, left_star, prefix_columns
from riskfeat.operators.encode import LabelCodes, LabelRates, fit_vocabulary, sparse_crosstab
from riskfeat.sources.schema import CATEGORIES_NARROW, CATEGORIES_WIDE, SourceTables

# Category texts and scores of the source data.
PAY_ONLINE = "在线支付"
PAY_ON_DELIVERY = "货到付款"
ORDER_DONE = "完成"
CREDIT_CARD = "信用卡"
CREDIT_CARD_SCORE = 0.0154925
OTHER_CARD_SCORE = 0.02607069
MATRIX_START = "2017-01-01"
VALIDATION_CUT = "2017-04-01"
VALIDATION_YEAR, VALIDATION_MONTH = 2017, 4

# carried along but never a feature
KEYS = ("id", "split", "target", "appl_sbm_tm")


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def fit_regions(receive: DataFrame) -> list[str]:
    """Region prefixes to count; fit on train on top of test."""
    return fit_vocabulary(receive, {"region": clean.text_prefix("region")})["region"]


def fit_region_codes(receive: DataFrame) -> LabelCodes:
    """Codes of the region prefixes, for any number of them; fit on train on top of test."""
    return LabelCodes.fit(receive.select(clean.text_prefix("region").alias("region")), ["region"])


def region_vectors(receive: DataFrame, application: DataFrame, codes: LabelCodes) -> DataFrame:
    """(id, regions): a sparse count per region prefix, one row per application."""
    prefixed = receive.select("id", clean.text_prefix("region").alias("region"))
    return sparse_crosstab(prefixed, application, "id", "region", codes, "regions")


def order_events(order: DataFrame) -> DataFrame:
    """Orders with cleaned amounts and times."""
    return order.select(
        "id", "type_pay", "sts_order", "phone",
        clean.parse_number("amt_order").alias("amt_order"),
        clean.parse_number("unit_price").alias("unit_price"),
        clean.parse_timestamp_multi("time_order").alias("time_order"),
    )


def bankcard_counts(bankcard: DataFrame, auth: DataFrame | None = None) -> DataFrame:
    """Counts per id; with ``auth``, one row per id, also ``exist_phone``: 1 where the
    applicant's own phone is that of a card."""
    own = {} if auth is None else {"phone": auth.select("id", "phone")}
    values = agg.ValueRows(bankcard, "id", ["bank_name", "tail_num", "phone"], own)
    features = {
        "bank_name_len": values.distinct_with_null("bank_name"),
        "tail_num_len": values.distinct_with_null("tail_num"),
        "bank_phone_num": values.distinct("phone"),
    }
    if auth is not None:
        features["exist_phone"] = values.member("phone")
    return values.per_key(features)


def unused_bankcard_counts(bankcard: DataFrame) -> DataFrame:
    """Counts the original computes but does not join."""
    values = agg.ValueRows(bankcard, "id", ["card_type", "phone"])
    return values.per_key({
        "bankcard_count": values.row_count(),
        "card_type_count": values.distinct_with_null("card_type"),
        "phone_count": values.distinct_with_null("phone"),
    })


def order_history(events: DataFrame) -> DataFrame:
    return agg.per_key(events, "id", {
        "order_time_max": F.max("time_order"),
        "order_time_min": F.min("time_order"),
        "type_pay_zaixian": agg.count_where(F.col("type_pay") == PAY_ONLINE),
        "type_pay_huodao": agg.count_where(F.col("type_pay") == PAY_ON_DELIVERY),
        "order_time": agg.row_count(),
        "order_mean": F.avg("amt_order"),
        "order_time_set": agg.distinct_count_with_null("time_order"),
        "unit_price_mean": F.avg("unit_price"),
    })


def unused_order_history(events: DataFrame) -> DataFrame:
    """Order features the original holds switched off."""
    return agg.per_key(events, "id", {
        "mean_unit_price": F.avg("unit_price"),
        "mean_amt_order": F.avg("amt_order"),
        "order_phone_unique": agg.distinct_count("phone"),
        "order_many_success": agg.count_where(F.col("sts_order") == ORDER_DONE),
        "order_many_occur": agg.value_count("sts_order"),
    })


def receive_counts(receive: DataFrame, regions: list[str]) -> DataFrame:
    prefixed = receive.select("id", clean.text_prefix("region").alias("region"), "fix_phone")
    return agg.per_key(prefixed, "id", {
        **agg.crosstab("region", regions, "region_"),
        "fix_phone_count": agg.value_count("fix_phone"),
        "fix_phone_unique": agg.distinct_count("fix_phone"),
    })


def credit_columns(credit: DataFrame, inverse: bool = True) -> DataFrame:
    columns = {"can_use": clean.difference("quota", "overdraft")}
    if inverse:
        columns["credit_score_inverse"] = clean.inverted("credit_score")
    return credit.select("id", "credit_score", "quota", "overdraft", *_named(columns))


def feature_table_wide(tables: SourceTables, regions: list[str], fill: bool = True) -> DataFrame:
    """First feature table: one row per application, eight category columns.

    Each child table is aggregated once before it meets the application, so
    joins see at most one row per id.
    """
    auth = prefix_columns(
        tables.auth.select(
            "id", clean.parse_sentinel_date("auth_time").alias("time"), "id_card", "phone"
        ), "auth_",
    )
    user = tables.user.select(
        "id", "hobby", F.col("id_card").alias("user_id_card"), *CATEGORIES_WIDE,
        clean.parse_birthday("birthday").alias("birthday"),
        *_named(flags.birthday_flags("birthday")),
    )
    base = left_star(
        tables.application.select(*KEYS),
        [
            auth, user, credit_columns(tables.credit),
            bankcard_counts(tables.bankcard, tables.auth),
            order_history(order_events(tables.order)),
            receive_counts(tables.receive, regions),
        ],
    ).withColumn("quota_use_ratio", clean.smoothed_ratio("overdraft", "quota"))
    # the columns present when the original counts missing cells
    counted = [
        "auth_time", "auth_id_card", "auth_phone", "birthday", "hobby", "user_id_card",
        *CATEGORIES_WIDE, "credit_score", "quota", "overdraft", "credit_score_inverse", "can_use",
        "quota_use_ratio",
    ]
    out = base.select(
        *KEYS, *CATEGORIES_WIDE,
        "credit_score", "quota", "overdraft", "credit_score_inverse", "can_use", "quota_use_ratio",
        *_named(timefeat.date_parts("appl_sbm_tm", ("hour", "month", "year"))),
        flags.null_count(counted).alias("nan_num"),
        timefeat.floor_days("appl_sbm_tm", "auth_time").alias("diff_day"),
        timefeat.age_years("appl_sbm_tm", "birthday").alias("how_old"),
        flags.masked_match_code("auth_id_card", "user_id_card").alias("the_same_id"),
        "exist_phone", "bank_name_len", "tail_num_len", "bank_phone_num",
        "type_pay_zaixian", "type_pay_huodao",
        *flags.BIRTHDAY_LITERALS, "is_hou_in",
        *agg.value_columns("region_", regions), "fix_phone_count", "fix_phone_unique",
        flags.present("hobby").alias("is_hobby"), flags.present("user_id_card").alias("is_idcard"),
        flags.present("auth_id_card").alias("auth_idcard"), flags.present("auth_phone").alias("auth_phone"),
        timefeat.floor_days("appl_sbm_tm", "order_time_max").alias("day_order_max"),
        timefeat.floor_days("appl_sbm_tm", "order_time_min").alias("day_order_min"),
        "order_time", "order_mean", "order_time_set", "unit_price_mean",
    )
    return fill_zero(out, skip=KEYS) if fill else out


def bankcard_scores(bankcard: DataFrame, bank_rates: LabelRates | None = None) -> DataFrame:
    """Counts and mean scores per id; with ``bank_rates`` also the mean rate of the banks."""
    fold = [bank_rates.fold] if bank_rates is not None and bank_rates.fold else []
    values = agg.ValueRows(bankcard, ["id", *fold], ["bank_name", "phone", "card_type"])
    features = {
        "bank_name_len": values.distinct_with_null("bank_name"),
        "tail_num_len": values.row_count(),
        "bank_phone_num": values.distinct("phone"),
        "card_type_score_mean": values.mapped_mean("card_type", {CREDIT_CARD: CREDIT_CARD_SCORE}, OTHER_CARD_SCORE),
    }
    rows = values.rows
    if bank_rates is not None:
        # a bank's rate is looked up once per id, and counts as often as the id has its cards
        bank = F.when(F.col("column") == values.place["bank_name"], F.col("value"))
        rows = bank_rates.add_rate(rows.withColumn(bank_rates.category, bank), "bank_rate")
        rated = F.sum(F.when(F.col("bank_rate").isNotNull(), F.col("n")))
        features["bank_rate_mean"] = F.sum(F.col("bank_rate") * F.col("n")) / F.nullif(rated, F.lit(0))
    return values.per_key(features, rows).drop(*fold)


def orders_around_application(events: DataFrame, application: DataFrame, amount: str = "amt_order", suffix: str = "") -> DataFrame:
    """Order features before and after the application time, in one aggregate."""
    joined = agg.with_anchor(events, application, "id", "appl_sbm_tm")
    return agg.per_key(joined, "id", agg.before_after("time_order", "appl_sbm_tm", amount, suffix))


def fit_bank_rates(train: SourceTables, **options) -> LabelRates:
    """Default odds per bank, from labelled train applications."""
    return LabelRates.fit(train.bankcard, train.application, "id", "bank_name", "target", **options)


def since(rows: DataFrame, start: str) -> DataFrame:
    """All rows but train applications before ``start``."""
    return rows.where((F.col("split") != "train") | (F.col("appl_sbm_tm") >= F.lit(start).cast("timestamp_ntz")))


def feature_table_anchored(
    tables: SourceTables, bank_rates: LabelRates, start: str | None = MATRIX_START, fill: bool = True
) -> DataFrame:
    """Second feature table: events around the application, four category columns.

    Train applications before ``start`` are left out (after the rates were
    fitted on all of them).
    """
    auth = tables.auth.select(
        "id", clean.parse_sentinel_date("auth_time").alias("auth_time"), "id_card", "phone",
        flags.present_except("auth_time").alias("is_auth_time"),
        flags.present("id_card").alias("is_idcard"), flags.present("phone").alias("is_phone"),
    )
    user = tables.user.select(
        "id", "hobby", *CATEGORIES_NARROW,
        flags.present("hobby").alias("is_hobby"), flags.present("birthday").alias("is_birthday"),
        clean.parse_birthday("birthday").alias("birthday"),
    )
    application = tables.application.select(*KEYS)
    if start is not None:
        application = since(application, start)
    base = left_star(application, [
        auth, user, credit_columns(tables.credit, inverse=False),
        bankcard_scores(tables.bankcard, bank_rates),
        orders_around_application(order_events(tables.order), application),
    ])
    counted = [
        "auth_time", "id_card", "phone", "is_auth_time", "is_idcard", "is_phone",
        "birthday", "hobby", *CATEGORIES_NARROW, "is_hobby", "is_birthday",
        "credit_score", "quota", "overdraft", "can_use",
    ]
    around = timefeat.order_flags("is_auth_time", "auth_time", "appl_sbm_tm")
    out = base.select(
        *KEYS, *CATEGORIES_NARROW, "is_auth_time", "is_idcard", "is_phone", "is_hobby", "is_birthday",
        "credit_score", "quota", "overdraft", "can_use",
        *_named(timefeat.date_parts("appl_sbm_tm", prefix="loan_")),
        flags.null_count(counted).alias("nan_num"),
        timefeat.floor_days("appl_sbm_tm", "auth_time").alias("diff_day"),
        timefeat.floor_days("appl_sbm_tm", "birthday").alias("how_old"),
        *_named({f"auth_{name}": c for name, c in around.items()}),
        "bank_name_len", "tail_num_len", "bank_phone_num", "card_type_score_mean", "bank_rate_mean",
        "n_before", "n_after", "mean_before", "mean_after", "max_before", "min_after",
    )
    return fill_zero(out, skip=KEYS) if fill else out
