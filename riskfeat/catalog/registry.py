"""Collects the named queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskfeat.catalog.driver_tables import SQL
from riskfeat.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, folder)``; without ``sql`` only the rows are checked."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(tune(spark), folder)

        run.__name__ = name
        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# Cleaned forms of the derived tables, as SQL. The sentinels, date formats and
# the eight hours, which have to be those of the data.
AMOUNT = "CASE WHEN {c} NOT IN ('NA', 'null') THEN TRY_CAST({c} AS DOUBLE) END"
ORDER_TIME = (
    "CASE WHEN time_order IN ('0', 'NA', 'nan') THEN NULL "
    "WHEN contains(time_order, ':') THEN try_strptime(time_order, '%Y-%m-%d %H:%M:%S') "
    "ELSE TIMESTAMP '1970-01-01 00:00:00' + to_seconds(TRY_CAST(substr(time_order, 1, 10) AS BIGINT)) "
    "+ INTERVAL 8 HOUR END"
)
BIRTHDAY = (
    "CASE WHEN regexp_matches(birthday, '^19[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}$') "
    "AND NOT contains(birthday, '-0') THEN CAST(try_strptime(birthday, '%Y-%m-%d') AS DATE) END"
)
AUTH_TIME = "try_strptime(nullif(auth_time, '0000-00-00'), '%Y-%m-%d %H:%M:%S')"
REGION = "coalesce(substr(region, 1, 2), 'na')"

CLEAN = {
    "cleaned_order": f"""
  SELECT id, type_pay, sts_order, phone, {AMOUNT.format(c='amt_order')} AS amt_order,
    {AMOUNT.format(c='unit_price')} AS unit_price, {ORDER_TIME} AS time_order
  FROM order_info""",
    "cleaned_auth": f"SELECT id, {AUTH_TIME} AS auth_time, id_card, phone FROM auth",
    "cleaned_user": f"""
  SELECT * EXCLUDE (birthday), birthday AS birthday_text, {BIRTHDAY} AS birthday FROM user_info""",
    "prefixed_receive": f"SELECT id, {REGION} AS region, fix_phone FROM receive",
}
NEEDS = {
    "cleaned_order": "order_info", "cleaned_auth": "auth", "cleaned_user": "user_info",
    "prefixed_receive": "receive",
}


def with_tables(names: str, body: str) -> str:
    """``WITH`` the listed derived tables, then ``body``."""
    wanted: list[str] = []
    for name in names.split():
        for n in ([NEEDS[name]] if name in NEEDS else []) + [name]:
            if n not in wanted:
                wanted.append(n)
    parts = ",\n".join(f"{n} AS ({(CLEAN.get(n) or SQL[n]).strip()})" for n in wanted)
    body = body.strip()
    joiner = ",\n" if body.upper().startswith("WITH ") else "\n"
    return f"WITH {parts}{joiner}{body[5:] if joiner.startswith(',') else body}"


def days(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0) AS BIGINT)"
