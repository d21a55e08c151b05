"""Column expressions that turn dirty text into typed values. Missing is NULL.

Timestamps are TIMESTAMP_NTZ throughout, so results do not depend on the
session time zone.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Text the CSV reader of the original job took as missing.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)

# Sentinels and formats of the source columns.
MISSING_NUMBER = ("NA", "null")
MISSING_TIME = ("0", "NA", "nan")
ZERO_DATE = "0000-00-00"
CLOCK_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
DIGITS_PATTERN = r"^\d+$"
BIRTHDAY_PATTERN = r"^19\d{2}-\d{1,2}-\d{1,2}$"


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nullify(c: ColumnOrName, values: Iterable[str] = MISSING_TEXT) -> Column:
    """NULL where the text is one of ``values``."""
    c = as_col(c)
    return F.when(~c.isin(*values), c)


def parse_number(c: ColumnOrName) -> Column:
    """Text to double; sentinels, bad text and NaN give NULL."""
    c = as_col(c)
    # the JVM parser also takes a type suffix such as "12d", which is bad text here
    suffixed = c.endswith("d") | c.endswith("D") | c.endswith("f") | c.endswith("F")
    number = F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    return F.when(~(c.isin(*MISSING_NUMBER) | suffixed), number)


def parse_timestamp_multi(c: ColumnOrName, offset_hours: int = 8) -> Column:
    """Clock text as it stands; otherwise the first ten digits as epoch seconds.

    Epoch values are moved by ``offset_hours`` to the wall clock of the source.
    """
    c = as_col(c)
    digits = F.substring(c, 1, 10)
    epoch = F.lit(str(datetime(1970, 1, 1) + timedelta(hours=offset_hours))).cast("timestamp_ntz")
    seconds = F.lit(timedelta(seconds=1)) * digits.cast("bigint")
    return (
        F.when(c.isin(*MISSING_TIME), None)
        .when(c.contains(":"), F.when(c.rlike(CLOCK_PATTERN), c.try_cast("timestamp_ntz")))
        .when(digits.rlike(DIGITS_PATTERN), epoch + seconds)
    )


def parse_birthday(c: ColumnOrName, reject_zero_padded: bool = True) -> Column:
    """``19yy-m-d`` text to date; anything else and impossible dates give NULL.

    The default also rejects text holding ``-0`` (zero-padded parts).
    """
    c = as_col(c)
    ok = c.rlike(BIRTHDAY_PATTERN)
    if reject_zero_padded:
        ok = ok & ~c.contains("-0")
    return F.when(ok, c.try_cast("date"))


def parse_sentinel_date(c: ColumnOrName, sentinels: Iterable[str] = (ZERO_DATE,)) -> Column:
    """Date or date-time text to timestamp; sentinels and bad text give NULL."""
    return nullify(c, sentinels).try_cast("timestamp_ntz")


def text_prefix(c: ColumnOrName, length: int = 2) -> Column:
    """First characters; missing text becomes the prefix of ``nan``."""
    return F.coalesce(F.substring(as_col(c), 1, length), F.lit("nan"[:length]))


def text_last(c: ColumnOrName) -> Column:
    """Last character; missing text becomes ``n``."""
    return F.coalesce(F.right(as_col(c), F.lit(1)), F.lit("n"))


def map_category(c: ColumnOrName, mapping: dict[str, float], default: float) -> Column:
    """Literal lookup; unknown and missing give ``default``."""
    c = as_col(c)
    out = F.lit(float(default))
    for value, score in mapping.items():
        out = F.when(c == value, F.lit(float(score))).otherwise(out)
    return out


def difference(a: ColumnOrName, b: ColumnOrName) -> Column:
    return as_col(a) - as_col(b)


def inverted(c: ColumnOrName, top: float = 605) -> Column:
    """Distance below a fixed top score."""
    return F.lit(top) - as_col(c)


def smoothed_ratio(a: ColumnOrName, b: ColumnOrName, smooth: float = 0.01) -> Column:
    """``a / (b + smooth)``; NULL instead of an error when the sum is zero."""
    return as_col(a) / F.nullif(as_col(b) + F.lit(smooth), F.lit(0.0))


def fixed_decimals(c: ColumnOrName, digits: int = 4) -> Column:
    return F.when(as_col(c).isNotNull(), F.format_string(f"%.{digits}f", as_col(c)))
