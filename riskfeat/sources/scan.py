"""Reading tables. Nothing is inferred: every CSV scan has a declared schema."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfeat.functions.clean import nullify, parse_sentinel_date
from riskfeat.operators.assemble import fill_zero
from riskfeat.sources import records as rec
from riskfeat.sources.schema import (
    TABLE_COLUMNS,
    TEST_FILES,
    TRAIN_FILES,
    SourceTables,
    schema_of,
)


def declared(df: DataFrame, schema: T.StructType, *extra: str) -> DataFrame:
    """The columns of a schema, found by name, from a table of texts or of other types.

    Missing marks become NULL and typed columns are cast, bad text to NULL; a column the
    table does not have is NULL throughout.
    """
    out = []
    for field in schema.fields:
        if field.name not in df.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        c, held = F.col(f"`{field.name}`"), df.schema[field.name].dataType
        if held != field.dataType or isinstance(held, T.StringType):
            plain = isinstance(held, T.DateType) and isinstance(field.dataType, T.TimestampNTZType)
            c = c if plain or isinstance(held, (T.TimestampType, T.TimestampNTZType)) else nullify(c.cast("string"))
            if isinstance(field.dataType, T.TimestampNTZType) and isinstance(held, T.StringType):
                c = parse_sentinel_date(c)
            elif not isinstance(field.dataType, T.StringType):
                c = c.try_cast(field.dataType)
            else:
                c = c.cast("string")
        out.append(c.alias(field.name))
    return df.select(*out, *extra)


def _csv_records(spark: SparkSession, path: str) -> DataFrame | None:
    """Every record whole, where a quote stays open at the end of a line; None where the
    lines are the records, which one look at the lines tells."""
    lines = rec.lines_of(spark, path)
    return rec.records(lines) if rec.has_open_lines(lines) else None


def _csv_cells(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """The cells of records as text columns, named by the first header, beside ``record``."""
    header = found.where("header").select("text").first()
    names = next(csv.reader([header.text.rstrip("\r")])) if header else []
    # the record keeps a name that no cell has
    return rec.parsed(found, names) if names else spark.createDataFrame([], "record string")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """CSV with a header, columns found by name.

    Every column is read as text, so a bad cell spoils itself and not its row;
    missing marks become NULL and typed columns are then cast, bad text to NULL.
    The file may hold more columns, in any order. A quote within quotes is doubled.
    With ``multi_line`` the lines are looked at once: where one leaves a quote open, records
    are cut in parallel (see ``records``), otherwise every line is a record. Without it the
    look is spared, for files known to have no line breaks within cells.
    """
    found = _csv_records(spark, path) if multi_line else None
    if found is not None:
        return declared(_csv_cells(spark, path, found), schema)
    options = {"header": True, "quote": '"', "escape": '"'} | ({"lineSep": "\n"} if multi_line else {})
    return declared(_without_returns(spark.read.options(**options).csv(path)), schema)


def _without_returns(df: DataFrame) -> DataFrame:
    """Lines were cut at line feeds, so a carriage return may be left in the last column and its name."""
    if not df.columns:
        return df
    last = df.columns[-1]
    return df.select(*[F.col(f"`{c}`") for c in df.columns[:-1]], F.regexp_replace(f"`{last}`", "\r$", "").alias(last.rstrip("\r")))


def scan_rejected(spark: SparkSession, path: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """The records whose key is missing or does not parse, as text: the rows that ``scan_csv``
    gives a NULL key."""
    found = _csv_records(spark, path)
    if found is None:
        lines = rec.lines_of(spark, path)
        found = lines.select((F.col("value") == F.lit(_first_line(spark, path))).alias("header"), F.col("value").alias("text"))
    rows = _csv_cells(spark, path, found)
    return declared(rows, T.StructType([schema[key]]), "record").where(F.col(key).isNull()).select("record")


def _first_line(spark: SparkSession, path: str) -> str:
    first = rec.lines_of(spark, path).where("block = 0").select("value").first()
    return first.value if first else ""


def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; with a schema its declared columns and types, as from CSV."""
    df = spark.read.parquet(path)
    return df if schema is None else declared(df, schema)


def scan_features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A saved feature table, missing filled with 0; ``split`` prunes partitions."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    return fill_zero(df)


def read_sources(
    spark: SparkSession, folder: str, split: str, key_type: str = "bigint", fmt: str = "csv"
) -> SourceTables:
    """The seven tables of one split from one folder, rows with a key only; see ``read_rejected``
    for the others."""
    files = TRAIN_FILES if split == "train" else TEST_FILES
    tables = {}
    for table in TABLE_COLUMNS:
        path = f"{folder.rstrip('/')}/{files[table]}"
        schema = schema_of(table, key_type=key_type)
        rows = scan_csv(spark, path, schema) if fmt == "csv" else scan_parquet(spark, path.removesuffix(".csv"), schema)
        tables[table] = rows.where(F.col("id").isNotNull())
    application = tables["application"]
    if split != "train":
        application = application.withColumn("target", F.lit(-1))
    tables["application"] = application.withColumn("split", F.lit(split))
    return SourceTables(**tables)


def read_rejected(spark: SparkSession, folder: str, split: str, key_type: str = "bigint") -> DataFrame:
    """(split, table, record): the CSV records of one folder that have no key."""
    files = TRAIN_FILES if split == "train" else TEST_FILES
    parts = [
        scan_rejected(spark, f"{folder.rstrip('/')}/{files[table]}", schema_of(table, key_type=key_type))
        .select(F.lit(split).alias("split"), F.lit(table).alias("table"), "record")
        for table in TABLE_COLUMNS
    ]
    return reduce(DataFrame.unionByName, parts)
