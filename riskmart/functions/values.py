"""Missing-value, recode, cap and rounding expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskmart import constants as K


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def typed_or(c: Column | str, dtype: str, sentinel) -> Column:
    """Cast, then replace null (or a malformed value) by a typed sentinel."""
    return F.coalesce(as_column(c).try_cast(dtype), F.lit(sentinel).cast(dtype))


def missing_flag(c: Column | str) -> Column:
    """1 when the raw value is null; compute it before any fill."""
    return as_column(c).isNull().cast("int")


def presence_flag(c: Column | str, equals=None) -> Column:
    """1 when the value is present (or equal to ``equals``)."""
    c = as_column(c)
    hit = c.isNotNull() if equals is None else F.coalesce(c == F.lit(equals), F.lit(False))
    return hit.cast("int")


def flag(condition: Column) -> Column:
    """Condition to 0/1, a null condition counting as 0."""
    return F.when(condition, 1).otherwise(0)


def recode(c: Column | str, mapping: Mapping) -> Column:
    """Replace exact values, keep the rest."""
    c = as_column(c)
    out = None
    for old, new in mapping.items():
        out = F.when(c == F.lit(old), F.lit(new)) if out is None else out.when(c == F.lit(old), F.lit(new))
    return c if out is None else out.otherwise(c)


def null_if_in(c: Column | str, values: Iterable) -> Column:
    """Sentinels back to null, so they cannot enter arithmetic."""
    c = as_column(c)
    return F.when(~c.isin(list(values)), c)


def null_if_open_date(c: Column | str) -> Column:
    """Open-start and open-end sentinel dates back to null."""
    c = as_column(c)
    return F.when(~c.isin(F.lit(K.OPEN_START).cast("date"), F.lit(K.OPEN_END).cast("date")), c)


def money(c: Column | str, scale: int = 2) -> Column:
    """Exact decimal amount: sums do not depend on the order of the rows."""
    return as_column(c).cast(f"decimal(18,{scale})")


def rounded(c: Column | str, places: int = 2) -> Column:
    """Half-up rounding on the decimal value, returned as double."""
    return F.round(as_column(c).cast("decimal(28,9)"), places).cast("double")


def ratio(num: Column, den: Column, places: int, otherwise=0.0) -> Column:
    """``num / den`` rounded, ``otherwise`` when the denominator is not positive."""
    value = F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(otherwise).cast("double"))
    return rounded(value, places)


def capped(c: Column | str, ceiling: float) -> Column:
    c = as_column(c)
    return F.when(c > ceiling, F.lit(ceiling)).otherwise(c)


def anomaly_flag(c: Column | str, ceiling: float) -> Column:
    return flag(as_column(c) > ceiling)


def floor_at_zero(c: Column | str, only_if: Column | None = None) -> Column:
    """Negative to zero, optionally only where ``only_if`` holds; null stays null."""
    c = as_column(c)
    hit = c < 0 if only_if is None else (c < 0) & only_if
    return F.when(hit, F.lit(0)).otherwise(c)


def guarded_delta(a: Column | str, b: Column | str, undefined: int = K.DELTA_UNDEFINED) -> Column:
    """``a - b`` when both are valid (>= 0), else the undefined sentinel."""
    a, b = as_column(a), as_column(b)
    return F.coalesce(F.when((a >= 0) & (b >= 0), a - b), F.lit(undefined))


def to_number(c: Column | str) -> Column:
    """Text to double; anything that is not a number becomes null."""
    return as_column(c).try_cast("double")


def label_map(c: Column | str, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Value to label through a literal map."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.create_map(*pairs)[as_column(c).cast("string")]
    return found if default is None else F.coalesce(found, F.lit(default))
