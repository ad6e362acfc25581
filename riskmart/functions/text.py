"""Name cleaning and text-derived values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskmart.functions.values import as_column

NUMBER_PATTERN = r"[-+]?\d*\.\d+|\d+"


def clean_label(value) -> str:
    """Category value to a column-name fragment: ``Rec.Online`` -> ``REC_ONLINE``."""
    return re.sub(r"[^0-9A-Za-z]+", "_", str(value)).strip("_").upper()


def clean_label_column(c: Column | str) -> Column:
    """The same cleaning applied to values instead of names."""
    return F.upper(F.regexp_replace(F.regexp_replace(as_column(c), r"[^0-9A-Za-z]+", "_"), r"^_+|_+$", ""))


def token_count(c: Column | str, empty: str | None = None) -> Column:
    """Blank-separated tokens; the ``empty`` marker counts as none."""
    c = as_column(c)
    n = F.size(F.split(c, " "))
    return n if empty is None else F.when(c == F.lit(empty), F.lit(0)).otherwise(n)


def first_number(c: Column | str) -> Column:
    """First number written in a label, as double (null if there is none)."""
    return F.regexp_extract(as_column(c), f"({NUMBER_PATTERN})", 1).try_cast("double")


def control_flag(customer: Column | str, marks, start: int = 6, length: int = 2) -> Column:
    """True when the marker characters of the id belong to the control group."""
    return F.substring(as_column(customer), start, length).isin(list(marks))


def key_of(customer: Column | str, vintage: Column | str) -> Column:
    """Customer and vintage joined into the unique key."""
    return F.concat(as_column(customer).cast("string"), as_column(vintage).cast("string"))
