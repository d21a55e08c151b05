"""Category encoders: ``fit`` learns a vocabulary or rates, ``transform`` applies them.

Fit on train on top of test where both must share columns and codes; fit label
rates on train only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from riskfeat.functions.clean import ColumnOrName, as_col
from riskfeat.operators.aggregate import value_columns
from riskfeat.session import materialize, scratch_path

# As Spark's own pivot: a wider result has no sensible column list.
MAX_COLUMNS = 10_000


def column_values(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """``(column, value)``: the distinct non-null texts of each named column, in one pass."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("column"), c.cast("string").alias("value")) for name, c in named.items()
    ])
    found = df.select(F.explode(pairs).alias("pair")).select("pair.column", "pair.value")
    return found.where(F.col("value").isNotNull()).distinct()


def fit_vocabulary(
    df: DataFrame, columns: dict[str, Column] | list[str], max_values: int = MAX_COLUMNS
) -> dict[str, list[str]]:
    """Sorted distinct non-null texts of each column, in one pass.

    Copies are removed on the map side, so only the vocabulary is shuffled. A
    larger vocabulary than ``max_values`` in all raises: it cannot become columns.
    """
    named = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    rows = column_values(df, named).limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise ValueError(f"more than {max_values} distinct values in {list(named)}")
    found: dict[str, list[str]] = {name: [] for name in named}
    for row in rows:
        found[row["column"]].append(row["value"])
    return {name: sorted(values) for name, values in found.items()}


@dataclass(frozen=True)
class OneHot:
    """0/1 columns named ``<column>_<value>``; the encoded columns are dropped."""

    vocabulary: dict[str, list[str]]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> OneHot:
        return cls(fit_vocabulary(df, columns))

    def columns(self) -> list[str]:
        return value_columns("", [f"{c}_{v}" for c, values in self.vocabulary.items() for v in values])

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [F.col(c) for c in df.columns if c not in self.vocabulary]
        pairs = [(c, v) for c, values in self.vocabulary.items() for v in values]
        flags = [
            F.coalesce(F.col(c).cast("string") == v, F.lit(False)).cast("int").alias(name)
            for (c, v), name in zip(pairs, self.columns())
        ]
        return df.select(kept + flags)


def ranked_values(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """``(column, value, code)``, the distinct texts of each column with their 0-based
    rank, for vocabularies of any size; and the number of values of each column.

    Range partitioned and sorted within partitions, so the rank is the local
    position plus the sizes of the partitions before. The sorted table is
    saved first: positions must not move when a task is run again.
    """
    local_bits = F.lit((1 << 33) - 1).cast("bigint")
    ordered = materialize(
        column_values(df, {c: F.col(c) for c in columns})
        .repartitionByRange("column", "value").sortWithinPartitions("column", "value")
        .select(
            "column", "value", F.spark_partition_id().alias("block"),
            F.monotonically_increasing_id().bitwiseAND(local_bits).alias("position"),
        )
    )
    # one row per partition and column: bounded by the shuffle width, not by the data
    parts = ordered.groupBy("block", "column").agg(F.count(F.lit(1)), F.min("position")).collect()
    offsets, totals = [], dict.fromkeys(columns, 0)
    for block, column, size, first in sorted(parts):
        offsets.append((block, column, totals[column] - first))
        totals[column] += size
    blocks = df.sparkSession.createDataFrame(offsets, "block int, column string, start bigint")
    ranked = ordered.join(F.broadcast(blocks), ["block", "column"]).select(
        "column", "value", (F.col("start") + F.col("position")).alias("code")
    )
    return ranked, totals


@dataclass(frozen=True)
class LabelCodes:
    """Ordinal codes by sorted vocabulary; unseen and missing values give NULL.

    One path at every size: the codes are a saved table that is joined by value,
    and Spark picks the join from the size of that table.
    """

    codes: DataFrame
    sizes: dict[str, int]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> LabelCodes:
        ranked, sizes = ranked_values(df, columns)
        return cls(materialize(ranked), sizes)

    def transform(self, df: DataFrame, as_category: bool = False) -> DataFrame:
        """Codes as integers, or as doubles that tree learners take for categories."""
        order = df.columns
        for column in self.sizes:
            side = self.codes.where(F.col("column") == column).select(
                F.col("value").alias("__value"), F.col("code").alias("__code")
            )
            joined = df.join(side, F.col(column).cast("string") == F.col("__value"), "left")
            df = joined.select([self._code(c, as_category) if c == column else F.col(c) for c in order])
        return df

    def _code(self, column: str, as_category: bool) -> Column:
        if not as_category:
            return F.col("__code").alias(column)
        # the vector assembler keeps this mark on double columns only
        return F.col("__code").cast("double").alias(column, metadata=nominal(column, self.sizes[column]))


def nominal(column: str, size: int) -> dict:
    """The mark by which the learners know a category of so many values."""
    return {"ml_attr": {"type": "nominal", "name": column, "num_vals": size}}


def one_hot_vectors(df: DataFrame, sizes: dict[str, int], names: dict[str, str]) -> DataFrame:
    """A 0/1 vector named ``names[c]`` beside each code column ``c`` of ``sizes[c]`` values.

    The vectors are sparse, so no vocabulary is too large and no column is named after
    a value. A missing code gives zeros, and so does a column without any value.
    """
    sizes = {c: max(n, 1) for c, n in sizes.items()}
    marked = {c: f"{c}__marked" for c in sizes}
    out = df.select("*", *[
        # one past the codes, which the encoder keeps as the category it drops
        F.coalesce(F.col(c).cast("double"), F.lit(float(n))).alias(marked[c], metadata=nominal(c, n))
        for c, n in sizes.items()
    ])
    encoder = OneHotEncoder(
        inputCols=list(marked.values()), outputCols=[names[c] for c in sizes], handleInvalid="keep", dropLast=True
    )
    return encoder.fit(out).transform(out).drop(*marked.values())


def label_counts(label: ColumnOrName) -> dict[str, Column]:
    """The two columns of a cross-tab against a 0/1 label."""
    label = as_col(label)
    return {"n0": F.count_if(label == 0), "n1": F.count_if(label == 1)}


def smoothed_odds(n1: ColumnOrName, n0: ColumnOrName, smooth: float = 0.1) -> Column:
    return as_col(n1) / (as_col(n0) + F.lit(smooth))


@dataclass(frozen=True)
class LabelRates:
    """Smoothed default odds per category, learned from labelled rows.

    ``unseen`` is used for a category absent from the fit; None leaves it out of
    the mean. A missing category is always left out. With ``fold`` the rate of a
    row comes from the other folds only.
    """

    category: str
    fitted: DataFrame
    unseen: float | None = None
    fold: str | None = None

    @classmethod
    def fit(
        cls, events: DataFrame, labelled: DataFrame, key: str, category: str, label: str,
        smooth: float = 0.1, unseen: float | str | None = None, fold: str | None = None,
        folds: int = 5,
    ) -> LabelRates:
        """``unseen`` may be a number, None, or "global" for the overall odds."""
        cols = [key, label] + ([fold] if fold else [])
        seen = events.select(key, category).join(labelled.select(*cols), key)
        groups = [category] + ([fold] if fold else [])
        # a missing category has no rate, but counts for the overall odds
        every = materialize(seen.groupBy(*groups).agg(*[c.alias(n) for n, c in label_counts(label).items()]))
        counts = every.where(F.col(category).isNotNull())
        if fold:
            # every fold needs the rate of every category, seen in that fold or not
            grid = counts.groupBy(category).agg(
                F.sum("n0").alias("all0"), F.sum("n1").alias("all1")
            ).withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
            counts = grid.join(counts, groups, "left").select(
                *groups,
                (F.col("all0") - F.coalesce("n0", F.lit(0))).alias("n0"),
                (F.col("all1") - F.coalesce("n1", F.lit(0))).alias("n1"),
            )
        fitted = counts.select(*groups, smoothed_odds("n1", "n0", smooth).alias("rate"))
        if fold:
            fitted = materialize(fitted)
        if unseen == "global":
            n1, n0 = every.agg(F.sum("n1"), F.sum("n0")).first()
            unseen = (n1 or 0) / ((n0 or 0) + smooth)
        return cls(category, fitted, unseen, fold)

    def add_rate(self, events: DataFrame, name: str = "rate") -> DataFrame:
        """The rows with the rate of each one's category, to be averaged beside other features."""
        groups = [self.category] + ([self.fold] if self.fold else [])
        joined = events.join(self.fitted, groups, "left")
        rate = F.col("rate")
        if self.unseen is not None:
            rate = F.when(F.col(self.category).isNotNull(), F.coalesce(rate, F.lit(float(self.unseen))))
        return joined.select(*events.columns, rate.alias(name))

    def mean_per_key(self, events: DataFrame, key: str, name: str) -> DataFrame:
        """Mean rate over the rows of each key."""
        groups = [self.category] + ([self.fold] if self.fold else [])
        return self.add_rate(events.select(key, *groups), name).groupBy(key).agg(F.avg(name).alias(name))


@dataclass(frozen=True)
class OutOfFoldRates:
    """The share of label 1 of each category, in place of the category: tree learners then put
    a category of any number of values in order before they cut it into bins.

    A labelled row gets the share among the rows of the other folds, every other row that among
    all labelled rows. Shares are drawn to the overall share as by ``smooth`` more rows, so
    rare values stand in the middle; unseen and missing values have the overall share.
    """

    fitted: DataFrame
    columns: list[str]
    prior: float
    fold: str

    @classmethod
    def fit(cls, labelled: DataFrame, columns: list[str], label: str = "target", fold: str = "fold", folds: int = 5, smooth: float = 10.0) -> OutOfFoldRates:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        long = labelled.select(F.col(fold).alias("fold__"), F.col(label).alias("label__"), F.inline(cells))
        counts = materialize(long.groupBy("column", "value", "fold__").agg(
            F.count_if(F.col("label__") == 0).alias("n0"), F.count_if(F.col("label__") == 1).alias("n1")
        ))
        n0, n1 = counts.where(F.col("column") == columns[0]).agg(F.sum("n0"), F.sum("n1")).first()
        prior = (n1 or 0) / (((n1 or 0) + (n0 or 0)) or 1)
        # each value for every fold, and for the rows that are in none
        grid = counts.groupBy("column", "value").agg(F.sum("n0").alias("all0"), F.sum("n1").alias("all1"))
        grid = grid.withColumn("fold__", F.explode(F.sequence(F.lit(-1), F.lit(folds - 1))))
        left = grid.join(counts, ["column", "value", "fold__"], "left").where(F.col("value").isNotNull()).select(
            "column", "value", "fold__",
            (F.col("all0") - F.coalesce("n0", F.lit(0))).alias("n0"), (F.col("all1") - F.coalesce("n1", F.lit(0))).alias("n1"),
        )
        rate = (F.col("n1") + F.lit(smooth * prior)) / (F.col("n0") + F.col("n1") + F.lit(smooth))
        return cls(materialize(left.select("column", "value", "fold__", rate.alias("rate"))), columns, prior, fold)

    def transform(self, df: DataFrame, is_labelled: Column) -> DataFrame:
        """``<c>__rate`` beside the columns of ``df``."""
        order = df.columns
        row_fold = F.when(is_labelled, F.col(self.fold)).otherwise(F.lit(-1)).alias("row_fold__")
        for column in self.columns:
            side = self.fitted.where(F.col("column") == column).select(
                F.col("value").alias("__value"), F.col("fold__").alias("__fold"), F.col("rate").alias("__rate")
            )
            rows = df.select("*", row_fold)
            joined = rows.join(side, (F.col(column).cast("string") == F.col("__value")) & (F.col("row_fold__") == F.col("__fold")), "left")
            df = joined.select(*order, F.coalesce("__rate", F.lit(self.prior)).alias(f"{column}__rate"))
            order = df.columns
        return df


def sparse_crosstab(df: DataFrame, keys: DataFrame, key: str, column: str, codes: LabelCodes, name: str) -> DataFrame:
    """(key, name): how often each value of ``column`` occurs in the rows of a key, as a sparse
    vector with a place per code, for any number of values. ``keys`` lists the keys; one
    without rows has an empty vector.

    The counts are (key, code, n) rows, added up on the map side; no key is pivoted and no
    column named after a value. The vectors are written as their parts and read as vectors.
    """
    coded = codes.transform(df.select(key, column))
    counts = coded.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("n"))
    # a key's entry holds its different values, at most the vocabulary
    cells = counts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(column).cast("int").alias("i"), F.col("n").cast("double").alias("n")))).alias("cells"))
    places = F.coalesce(F.transform("cells", lambda c: c.i), F.array().cast("array<int>"))
    numbers = F.coalesce(F.transform("cells", lambda c: c.n), F.array().cast("array<double>"))
    size = max(codes.sizes[column], 1)
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), places.alias("indices"), numbers.alias("values"))
    rows = keys.select(key).distinct().join(cells, key, "left").select(key, parts.alias(name))
    path = scratch_path(df.sparkSession, "vectors")
    rows.write.parquet(path)
    marked = StructField(name, VectorUDT(), True, {"ml_attr": {"num_attrs": size}})
    return df.sparkSession.read.schema(StructType([rows.schema[key], marked])).parquet(path)


def assemble_vector(df: DataFrame, keep: list[str], out: str = "features") -> DataFrame:
    """All columns but ``keep`` as one vector, in column order."""
    inputs = [c for c in df.columns if c not in keep]
    assembler = VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="error")
    return assembler.transform(df).select(*keep, out)
