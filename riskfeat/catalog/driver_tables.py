"""The seven source tables derived from the star-schema tables of a data folder.

Those tables hold no missing or dirty cells, so both are put in by fixed rules on
the keys. ``SQL`` states the same tables for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfeat.plans.features import CREDIT_CARD, ORDER_DONE, PAY_ON_DELIVERY, PAY_ONLINE
from riskfeat.sources.schema import SourceTables


# Declared, so opening a table reads no file footer.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def application(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    hours = F.make_dt_interval(F.lit(0), F.pmod(key, F.lit(24)).cast("int"))
    return table(spark, folder, "orders").select(
        key.alias("id"),
        (F.col("o_orderdate") + hours).alias("appl_sbm_tm"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("target"),
        F.when(key % 7 == 0, "test").otherwise("train").alias("split"),
    )


def auth(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    days = F.make_dt_interval(((key * 7) % 41 - 20).cast("int"))
    return table(spark, folder, "orders").where(key % 9 != 0).select(
        key.alias("id"),
        F.when(key % 13 == 1, "0000-00-00").when(key % 13 != 0, _text(F.col("o_orderdate") + days)).alias("auth_time"),
        F.when(key % 7 != 0, F.concat(_text(key % 4), F.lit("****"), _text(key % 3))).alias("id_card"),
        F.when(key % 11 != 0, F.concat(F.lit("1"), _text((key * 3) % 20))).alias("phone"),
    )


def credit(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = table(spark, folder, "orders").where(key % 8 != 0)
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return orders.join(customer, "o_custkey").select(
        key.alias("id"),
        F.when(key % 6 != 0, (key % 150 + 450).cast("double")).alias("credit_score"),
        F.when(key % 10 != 3, F.col("c_acctbal")).alias("quota"),
        F.when(key % 10 != 4, F.col("o_totalprice") / 64).alias("overdraft"),
    )


def user(spark: SparkSession, folder: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    year = F.concat(F.lit("19"), _text(cust % 40 + 60), F.lit("-"))
    kind = key % 10
    birthday = (
        F.when(kind == 1, "--").when(kind == 2, "0-0-0").when(kind == 3, "1-1-1")
        .when(kind == 4, "0000-00-00").when(kind == 5, "0001-1-1").when(kind == 6, "85后")
        .when(kind == 7, F.concat(year, _text(cust % 3 + 10), F.lit("-"), _text(cust % 20 + 10)))
        .when(kind == 8, F.concat(year, _text(cust % 9 + 1), F.lit("-"), _text(cust % 31 + 1)))
        .when(kind == 9, F.concat(year, F.lit("0"), _text(cust % 9 + 1), F.lit("-15")))
    )
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"
    )
    orders = table(spark, folder, "orders").where(key % 12 != 5)
    return orders.join(customer, "o_custkey").select(
        key.alias("id"), birthday.alias("birthday"),
        F.when(key % 4 != 0, F.concat(F.lit("h"), _text(key % 6))).alias("hobby"),
        F.when(key % 5 != 1, F.concat(_text(key % 4), F.lit("####"), _text(key % 6 % 3 + cust % 2))).alias("id_card"),
        F.when(cust % 10 != 0, F.when(cust % 2 == 0, "男").otherwise("女")).alias("sex"),
        F.col("c_mktsegment").alias("merriage"),
        F.when(cust % 7 != 0, _text(F.col("c_nationkey") % 5)).alias("income"),
        F.when(cust % 6 != 0, _text(cust % 4)).alias("degree"),
        F.when(cust % 3 != 0, _text(F.col("c_nationkey"))).alias("industry"),
        _text(key % 2).alias("qq_bound"), _text(cust % 2).alias("wechat_bound"),
        F.when(cust % 11 != 0, F.concat(F.lit("G"), _text(cust % 5))).alias("account_grade"),
    )


def bankcard(spark: SparkSession, folder: str) -> DataFrame:
    part = F.col("l_partkey")
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return table(spark, folder, "lineitem").join(supplier, "l_suppkey").select(
        F.col("l_orderkey").alias("id"),
        F.when(part % 17 != 0, F.col("s_name")).alias("bank_name"),
        F.when(F.col("l_linestatus") == "F", CREDIT_CARD).when(part % 19 != 0, "储蓄卡").alias("card_type"),
        F.when(part % 5 != 0, F.concat(F.lit("1"), _text(part % 20))).alias("phone"),
        F.when(part % 23 != 0, _text(part % 1000)).alias("tail_num"),
    )


def order(spark: SparkSession, folder: str) -> DataFrame:
    part = F.col("l_partkey")
    ship, flag = F.col("l_shipdate"), F.col("l_returnflag")
    epoch = F.lit("1970-01-01").cast("date")
    seconds = F.date_diff(ship.cast("date"), epoch).cast("bigint") * 86400
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.when(part % 10 == 0, "NA").when(part % 10 == 1, "null").when(part % 14 != 5, _text(F.col("l_extendedprice"))).alias("amt_order"),
        F.when(part % 9 == 0, "NA").when(part % 15 != 4, _text(F.col("l_quantity"))).alias("unit_price"),
        F.when(part % 16 == 0, "0").when(part % 16 == 1, "NA").when(part % 16 < 6, _text(seconds))
        .when(part % 16 != 6, _text(ship)).alias("time_order"),
        F.when(flag == "A", PAY_ONLINE).when(flag == "N", PAY_ON_DELIVERY).when(part % 4 != 0, "other").alias("type_pay"),
        F.when(F.col("l_linestatus") == "F", ORDER_DONE).when(part % 3 != 0, "open").alias("sts_order"),
        F.when(part % 5 != 0, F.concat(F.lit("1"), _text(part % 20))).alias("phone"),
    )


def receive(spark: SparkSession, folder: str) -> DataFrame:
    part = F.col("l_partkey")
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    region = table(spark, folder, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    located = supplier.join(nation, "s_nationkey").join(region, "n_regionkey").select("l_suppkey", "r_name")
    return table(spark, folder, "lineitem").join(located, "l_suppkey").select(
        F.col("l_orderkey").alias("id"),
        F.when(part % 29 != 0, F.col("r_name")).alias("region"),
        F.when(part % 3 != 0, _text(part % 7)).alias("fix_phone"),
    )


def sources(spark: SparkSession, folder: str) -> SourceTables:
    return SourceTables(**{
        f.__name__: f(spark, folder)
        for f in (auth, bankcard, credit, order, receive, application, user)
    })


# The same tables in SQL, by name; a query lists those it needs.
SQL = {
    "application": """
  SELECT o_orderkey AS id,
    o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS appl_sbm_tm,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
    CASE WHEN o_orderkey % 7 = 0 THEN 'test' ELSE 'train' END AS split
  FROM orders""",
    "auth": """
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 13 = 1 THEN '0000-00-00'
      WHEN o_orderkey % 13 <> 0
      THEN strftime(o_orderdate + ((o_orderkey * 7) % 41 - 20) * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S')
    END AS auth_time,
    CASE WHEN o_orderkey % 7 <> 0
      THEN CAST(o_orderkey % 4 AS VARCHAR) || '****' || CAST(o_orderkey % 3 AS VARCHAR) END AS id_card,
    CASE WHEN o_orderkey % 11 <> 0 THEN '1' || CAST((o_orderkey * 3) % 20 AS VARCHAR) END AS phone
  FROM orders WHERE o_orderkey % 9 <> 0""",
    "credit": """
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 150 + 450 AS DOUBLE) END AS credit_score,
    CASE WHEN o_orderkey % 10 <> 3 THEN c_acctbal END AS quota,
    CASE WHEN o_orderkey % 10 <> 4 THEN o_totalprice / 64 END AS overdraft
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 8 <> 0""",
    "user_info": """
  SELECT o_orderkey AS id,
    CASE o_orderkey % 10 WHEN 1 THEN '--' WHEN 2 THEN '0-0-0' WHEN 3 THEN '1-1-1'
      WHEN 4 THEN '0000-00-00' WHEN 5 THEN '0001-1-1' WHEN 6 THEN '85后'
      WHEN 7 THEN '19' || CAST(o_custkey % 40 + 60 AS VARCHAR) || '-' || CAST(o_custkey % 3 + 10 AS VARCHAR)
        || '-' || CAST(o_custkey % 20 + 10 AS VARCHAR)
      WHEN 8 THEN '19' || CAST(o_custkey % 40 + 60 AS VARCHAR) || '-' || CAST(o_custkey % 9 + 1 AS VARCHAR)
        || '-' || CAST(o_custkey % 31 + 1 AS VARCHAR)
      WHEN 9 THEN '19' || CAST(o_custkey % 40 + 60 AS VARCHAR) || '-0' || CAST(o_custkey % 9 + 1 AS VARCHAR)
        || '-15'
    END AS birthday,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'h' || CAST(o_orderkey % 6 AS VARCHAR) END AS hobby,
    CASE WHEN o_orderkey % 5 <> 1 THEN CAST(o_orderkey % 4 AS VARCHAR) || '####'
      || CAST(o_orderkey % 6 % 3 + o_custkey % 2 AS VARCHAR) END AS id_card,
    CASE WHEN o_custkey % 10 <> 0 THEN CASE WHEN o_custkey % 2 = 0 THEN '男' ELSE '女' END END AS sex,
    c_mktsegment AS merriage,
    CASE WHEN o_custkey % 7 <> 0 THEN CAST(c_nationkey % 5 AS VARCHAR) END AS income,
    CASE WHEN o_custkey % 6 <> 0 THEN CAST(o_custkey % 4 AS VARCHAR) END AS degree,
    CASE WHEN o_custkey % 3 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS industry,
    CAST(o_orderkey % 2 AS VARCHAR) AS qq_bound,
    CAST(o_custkey % 2 AS VARCHAR) AS wechat_bound,
    CASE WHEN o_custkey % 11 <> 0 THEN 'G' || CAST(o_custkey % 5 AS VARCHAR) END AS account_grade
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 12 <> 5""",
    "bankcard": """
  SELECT l_orderkey AS id,
    CASE WHEN l_partkey % 17 <> 0 THEN s_name END AS bank_name,
    CASE WHEN l_linestatus = 'F' THEN '信用卡' WHEN l_partkey % 19 <> 0 THEN '储蓄卡' END AS card_type,
    CASE WHEN l_partkey % 5 <> 0 THEN '1' || CAST(l_partkey % 20 AS VARCHAR) END AS phone,
    CASE WHEN l_partkey % 23 <> 0 THEN CAST(l_partkey % 1000 AS VARCHAR) END AS tail_num
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "order_info": """
  SELECT l_orderkey AS id,
    CASE WHEN l_partkey % 10 = 0 THEN 'NA' WHEN l_partkey % 10 = 1 THEN 'null'
      WHEN l_partkey % 14 <> 5 THEN CAST(l_extendedprice AS VARCHAR) END AS amt_order,
    CASE WHEN l_partkey % 9 = 0 THEN 'NA' WHEN l_partkey % 15 <> 4 THEN CAST(l_quantity AS VARCHAR) END AS unit_price,
    CASE WHEN l_partkey % 16 = 0 THEN '0' WHEN l_partkey % 16 = 1 THEN 'NA'
      WHEN l_partkey % 16 < 6
      THEN CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * 86400 AS VARCHAR)
      WHEN l_partkey % 16 <> 6 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS time_order,
    CASE l_returnflag WHEN 'A' THEN '在线支付' WHEN 'N' THEN '货到付款'
      ELSE CASE WHEN l_partkey % 4 <> 0 THEN 'other' END END AS type_pay,
    CASE WHEN l_linestatus = 'F' THEN '完成' WHEN l_partkey % 3 <> 0 THEN 'open' END AS sts_order,
    CASE WHEN l_partkey % 5 <> 0 THEN '1' || CAST(l_partkey % 20 AS VARCHAR) END AS phone
  FROM lineitem""",
    "receive": """
  SELECT l_orderkey AS id,
    CASE WHEN l_partkey % 29 <> 0 THEN r_name END AS region,
    CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_partkey % 7 AS VARCHAR) END AS fix_phone
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}
