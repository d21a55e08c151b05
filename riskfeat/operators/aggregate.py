"""Per-entity aggregates over child tables.

A feature is a named aggregate ``Column``; all features of one child table go
into one ``groupBy(key).agg`` so the table is read and shuffled once, with the
map-side partial aggregate shrinking hot keys before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.functions.clean import ColumnOrName, as_col


def per_key(df: DataFrame, key: str | list[str], features: dict[str, Column]) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in features.items()])


def row_count() -> Column:
    return F.count(F.lit(1))


def value_count(c: ColumnOrName) -> Column:
    return F.count(as_col(c))


def distinct_count(c: ColumnOrName) -> Column:
    """Distinct values, missing not counted."""
    return F.count_distinct(as_col(c))


def distinct_count_with_null(c: ColumnOrName) -> Column:
    """Distinct values where missing counts as one more value.

    A struct around the value is never NULL, so no second aggregate is needed.
    """
    return F.count_distinct(F.struct(as_col(c)))


class ValueRows:
    """The different values of several child columns, once per key, with their rows counted.

    ``rows`` are (key, column, value, n): one shuffle after a partial count on the map side, by
    key and value, so a hot key is spread and holds each value once. Any number of distinct
    counts, of counts by value and of memberships is then one plain aggregate per key, where
    Spark's own plan for several distinct counts copies every raw row for each of them.
    """

    def __init__(self, df: DataFrame, key: str | list[str], columns: list[str], own: dict[str, DataFrame] | None = None):
        """``own[c]`` holds (key, c): values to look for among those of column ``c``."""
        self.keys, self.place = [key] if isinstance(key, str) else key, {c: i for i, c in enumerate(columns)}
        cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("string").alias("value")) for c, i in self.place.items()])
        long = df.select(*self.keys, F.inline(cells)).withColumns({"n": F.lit(1).cast("long"), "own": F.lit(0)})
        for c, rows in (own or {}).items():
            asked = rows.where(F.col(c).isNotNull())
            long = long.unionByName(asked.select(
                *self.keys, F.lit(self.place[c]).alias("column"), F.col(c).cast("string").alias("value"),
                F.lit(0).cast("long").alias("n"), F.lit(1).alias("own"),
            ))
        self.rows = long.groupBy(*self.keys, "column", "value").agg(F.sum("n").alias("n"), F.max("own").alias("own"))

    def _held(self, column: str) -> Column:
        return (F.col("column") == self.place[column]) & (F.col("n") > 0)

    def distinct(self, column: str) -> Column:
        """Different values, missing not counted."""
        return F.count_if(self._held(column) & F.col("value").isNotNull())

    def distinct_with_null(self, column: str) -> Column:
        """Different values where missing counts as one more value."""
        return F.count_if(self._held(column))

    def row_count(self) -> Column:
        """Every raw row has one value in each column."""
        return F.sum(F.when(F.col("column") == 0, F.col("n")))

    def count_of(self, column: str, value: str) -> Column:
        return F.coalesce(F.sum(F.when(self._held(column) & (F.col("value") == value), F.col("n"))), F.lit(0))

    def member(self, column: str) -> Column:
        """1 where a value looked for is among the key's values, else NULL."""
        return F.max(F.when(self._held(column) & (F.col("own") == 1), 1))

    def mapped_mean(self, column: str, mapping: dict[str, float], default: float) -> Column:
        """As ``mapped_mean``, from the counts of the values."""
        counts = {value: self.count_of(column, value) for value in mapping}
        total = (self.row_count() - sum(counts.values(), F.lit(0))) * F.lit(float(default))
        for value, score in mapping.items():
            total = total + counts[value] * F.lit(float(score))
        return total / F.nullif(self.row_count(), F.lit(0))

    def per_key(self, features: dict[str, Column], rows: DataFrame | None = None) -> DataFrame:
        """One row per key that has raw rows; ``rows`` may be ``self.rows`` with more columns."""
        out = (self.rows if rows is None else rows).groupBy(*self.keys).agg(
            *[c.alias(name) for name, c in features.items()], self.row_count().alias("rows__")
        )
        return out.where("rows__ > 0").drop("rows__")


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def mapped_mean(c: ColumnOrName, mapping: dict[str, float], default: float) -> Column:
    """Mean of the score that each value is mapped to; other and missing values have ``default``.

    Made of counts, so the order of the rows does not move the last digit.
    """
    c = as_col(c)
    counts = {value: F.count_if(c == value) for value in mapping}
    listed = sum(counts.values(), F.lit(0))
    total = (row_count() - listed) * F.lit(float(default))
    for value, score in mapping.items():
        total = total + counts[value] * F.lit(float(score))
    return total / F.nullif(row_count(), F.lit(0))


def value_columns(prefix: str, values: list[str]) -> list[str]:
    """One column name per value: the prefix and the value, with any sign but letters, digits
    and ``_`` as its code point; where two would differ in case only, the later one is numbered."""
    names: list[str] = []
    for i, value in enumerate(values):
        name = prefix + "".join(x if x.isalnum() or x == "_" else f"_{ord(x):x}_" for x in value)
        while name.lower() in {n.lower() for n in names}:
            name = f"{name}_{i}"
        names.append(name)
    return names


def crosstab(c: ColumnOrName, values: Iterable[str], prefix: str) -> dict[str, Column]:
    """One zero-filled count per listed value, to be put beside other features."""
    c = as_col(c)
    values = list(values)
    return {name: F.count_if(c == v) for name, v in zip(value_columns(prefix, values), values)}


def before_after(
    time: ColumnOrName, anchor: ColumnOrName, amount: ColumnOrName,
    suffix: str = "", before_includes_tie: bool = False,
) -> dict[str, Column]:
    """Count, mean, largest-before and smallest-after around an anchor time.

    One pass of conditional aggregates. A tie falls in neither side, or before
    when ``before_includes_tie``.
    """
    time, anchor, amount = as_col(time), as_col(anchor), as_col(amount)
    before = (time <= anchor) if before_includes_tie else (time < anchor)
    after = time > anchor
    return {
        f"n_before{suffix}": F.count_if(before),
        f"n_after{suffix}": F.count_if(after),
        f"mean_before{suffix}": F.avg(F.when(before, amount)),
        f"mean_after{suffix}": F.avg(F.when(after, amount)),
        f"max_before{suffix}": F.max(F.when(before, amount)),
        f"min_after{suffix}": F.min(F.when(after, amount)),
    }


def with_anchor(child: DataFrame, application: DataFrame, key: str, anchor: str) -> DataFrame:
    """Child rows of known applicants with their anchor time (inner join).

    The application side has one row per key, so adaptive execution can split a
    hot key of the child side. Outer joins are left to the aggregated result.
    """
    return child.join(application.select(key, anchor), key, "inner")


def value_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """The set of values per key as rows: distinct non-null pairs.

    Shuffled by (key, value) after map-side removal of copies, so no key has to
    fit in one task.
    """
    return df.select(key, value).where(F.col(value).isNotNull()).distinct()
