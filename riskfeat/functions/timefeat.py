"""Time features on TIMESTAMP_NTZ values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskfeat.functions.clean import ColumnOrName, as_col


def _clock(c: Column) -> Column:
    """Time since midnight, as an interval."""
    return c - c.cast("date").cast("timestamp_ntz")


def floor_days(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Whole days in ``a - b``, rounded down (minus one hour is day -1).

    Calendar days, less one when the clock of ``a`` is behind that of ``b``.
    """
    a = as_col(a).cast("timestamp_ntz")
    b = as_col(b).cast("timestamp_ntz")
    borrow = (_clock(a) < _clock(b)).cast("int")
    return (F.date_diff(a.cast("date"), b.cast("date")) - borrow).cast("bigint")


def age_years(a: ColumnOrName, b: ColumnOrName) -> Column:
    return floor_days(a, b) / F.lit(365.0)


# Feature part -> Spark function.
_PARTS = {"hour": F.hour, "day": F.dayofmonth, "month": F.month, "year": F.year}


def date_parts(c: ColumnOrName, parts=("hour", "day", "month", "year"), prefix: str = "") -> dict[str, Column]:
    return {prefix + part: _PARTS[part](as_col(c)) for part in parts}


def order_flags(present: ColumnOrName, event: ColumnOrName, anchor: ColumnOrName) -> dict[str, Column]:
    """Guarded before/after flags and day distances of an event to its anchor."""
    ok, event, anchor = as_col(present) == 1, as_col(event), as_col(anchor)
    is_before, is_after = ok & (event < anchor), ok & (event > anchor)
    return {
        "before": F.when(is_before, 1).otherwise(0),
        "after": F.when(is_after, 1).otherwise(0),
        "before_days": F.when(is_before, floor_days(anchor, event)).otherwise(F.lit(0).cast("bigint")),
        "after_days": F.when(is_after, floor_days(event, anchor)).otherwise(F.lit(0).cast("bigint")),
    }
