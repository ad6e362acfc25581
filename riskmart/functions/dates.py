"""Date parsing and date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.functions.values import as_column, flag


def parse_day(c: Column | str, mask: str = K.STAMP_MASK, default: str | None = None) -> Column:
    """Text to date by mask.

    Month names may come in any case; a value that does not fit the mask is null
    and, like a null, takes ``default`` when one is given.
    """
    c = as_column(c)
    if "MMM" in mask:
        at = mask.index("MMM")
        c = F.concat(F.substring(c, 1, at), F.initcap(F.substring(c, at + 1, 3)),
                     F.substring(c, at + 4, 64))
    day = F.try_to_date(c, mask)
    return day if default is None else F.coalesce(day, F.lit(default).cast("date"))


def vintage_start(c: Column | str) -> Column:
    """``yyyyMM`` (text or number) to the first day of that month."""
    return F.try_to_date(as_column(c).cast("string"), K.VINTAGE_MASK)


def vintage_of(c: Column | str) -> Column:
    """Date to its integer ``yyyyMM`` vintage."""
    c = as_column(c)
    return F.year(c) * 100 + F.month(c)


def vintage_from_key(key: Column | str) -> Column:
    """First day of the vintage carried by the last six characters of a key."""
    return vintage_start(F.right(as_column(key), F.lit(6)))


def age_years(reference: Column | str, birth: Column | str) -> Column:
    """Complete years between two dates; the birth-date sentinel gives the unknown code."""
    birth = as_column(birth)
    age = F.floor(F.months_between(as_column(reference), birth) / 12).cast("int")
    return F.when(birth == F.lit(K.BIRTH_DATE_NULL).cast("date"), F.lit(K.UNKNOWN)).otherwise(age)


def tenure_months(reference: Column | str, start: Column | str) -> Column:
    """Months since ``start`` rounded to whole months, -1 when there is no start date."""
    months = F.round(F.months_between(as_column(reference), as_column(start)), 0)
    return F.coalesce(months, F.lit(-1.0))


def days_late(paid: Column | str, due: Column | str) -> Column:
    """Days past due, 0 unless both dates are real (not open-ended sentinels)."""
    paid, due = as_column(paid), as_column(due)
    real = (paid > F.lit(K.OPEN_START).cast("date")) & (due < F.lit(K.OPEN_END).cast("date"))
    return F.when(real, F.datediff(paid, due)).otherwise(F.lit(0))


def late_flag(days: Column | str) -> Column:
    return flag(as_column(days) > 0)


def part_columns(day: str, year: str, month: str) -> dict[str, Column]:
    """Year and month partition columns of a date column."""
    return {year: F.year(day), month: F.month(day)}
