"""Putting per-applicant tables side by side and train and test on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfeat.functions.clean import nullify
from riskfeat.operators.aggregate import value_pairs


def prefix_columns(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rename before a join so no two sources share a column name."""
    return df.select([F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def left_star(base: DataFrame, parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Left join of tables that hold at most one row per key.

    The row count of ``base`` never changes. Aggregated parts already are
    partitioned by the key, so only ``base`` and raw parent tables are shuffled.
    """
    for part in parts:
        base = base.join(part, key, "left")
    return base


def member_keys(owner: DataFrame, child: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Keys whose own ``value`` is among the values of their child rows.

    A semi join on (key, value) against distinct pairs: no list per key is ever
    built. Left join the result and fill 0 for the others.
    """
    pairs = value_pairs(child, key, value)
    return owner.join(pairs, [key, value], "left_semi").select(key, F.lit(1).alias(name))


def right_join(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """All child rows of known parents, and one row for each parent without any.

    Spark cannot split a hot key on the side of an outer join that is not
    preserved. So the matches are an inner join, which it can split, and the
    other parents are found against the distinct keys of the child.
    """
    matched = child.join(parent, key, "inner")
    alone = parent.join(child.select(key).distinct(), key, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def union_split(train: DataFrame, test: DataFrame, label: str = "target", unlabeled: int = -1) -> DataFrame:
    """Train on top of test, told apart by ``split``; columns matched by name.

    Test rows get the ``unlabeled`` mark as label.
    """
    top = train.withColumn("split", F.lit("train"))
    bottom = test.withColumn(label, F.lit(unlabeled)).withColumn("split", F.lit("test"))
    return top.unionByName(bottom, allowMissingColumns=True)


def fill_zero(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Missing numbers become 0, missing text "0"; other types stay."""
    out: list[Column] = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if field.name in skip:
            out.append(c)
        elif isinstance(field.dataType, T.NumericType):
            out.append(F.coalesce(c, F.lit(0).cast(field.dataType)).alias(field.name))
        elif isinstance(field.dataType, T.StringType):
            out.append(F.coalesce(c, F.lit("0")).alias(field.name))
        else:
            out.append(c)
    return df.select(out)


def nullify_text(df: DataFrame) -> DataFrame:
    """Every text column with the known missing marks turned to NULL."""
    return df.select([
        nullify(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])
