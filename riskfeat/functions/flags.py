"""0/1 indicator columns and small codes. A flag is never NULL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskfeat.functions.clean import ZERO_DATE, ColumnOrName, as_col

# Feature name -> literal birthday text it flags.
BIRTHDAY_LITERALS = {
    "is_double_": "--",
    "is_0_0_0": "0-0-0",
    "is_1_1_1": "1-1-1",
    "is_0000_00_00": "0000-00-00",
    "is_0001_1_1": "0001-1-1",
}
BIRTHDAY_DECADE_MARK = "后"


def to_flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def present(c: ColumnOrName) -> Column:
    return as_col(c).isNotNull().cast("int")


def present_except(c: ColumnOrName, sentinels: Iterable[str] = (ZERO_DATE,)) -> Column:
    """1 unless missing or one of the sentinel strings."""
    return to_flag(~as_col(c).isin(*sentinels))


def equals(c: ColumnOrName, value: str) -> Column:
    return to_flag(as_col(c) == value)


def contains(c: ColumnOrName, part: str) -> Column:
    return to_flag(as_col(c).contains(part))


def birthday_flags(c: ColumnOrName) -> dict[str, Column]:
    """Named flags for the known junk birthdays and the decade mark."""
    flags = {name: equals(c, text) for name, text in BIRTHDAY_LITERALS.items()}
    flags["is_hou_in"] = contains(c, BIRTHDAY_DECADE_MARK)
    return flags


def masked_match_code(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Compare two masked texts by their first and last characters.

    0 both missing, 1 only ``a``, 2 only ``b``, 3 same ends, 4 different ends.
    """
    a, b = as_col(a), as_col(b)
    same = (F.left(a, F.lit(1)) == F.left(b, F.lit(1))) & (
        F.right(a, F.lit(1)) == F.right(b, F.lit(1))
    )
    code = F.when(same, 3).otherwise(4)
    return F.when(a.isNull(), F.when(b.isNull(), 0).otherwise(2)).otherwise(
        F.when(b.isNull(), 1).otherwise(code)
    )


def null_count(columns: Iterable[ColumnOrName]) -> Column:
    """How many of the listed columns are NULL in this row."""
    total = F.lit(0)
    for c in columns:
        total = total + as_col(c).isNull().cast("int")
    return total
