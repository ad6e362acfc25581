"""Control-group removal, out-of-time split and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart import constants as K

TRAIN, OOT = "treino", "oot"
Splits = dict[str, dict[str, DataFrame]]


def _require(df: DataFrame, table: str, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"table {table}: column {column} is missing")


def oot_flag(vintage: str = K.VINTAGE, oot: Sequence[int] = K.OOT_VINTAGES) -> Column:
    return F.coalesce(F.col(vintage).cast("int").isin([int(v) for v in oot]).cast("int"), F.lit(0))


def split_label(vintage: str = K.VINTAGE, control: str = K.CONTROL, oot: Sequence[int] = K.OOT_VINTAGES,
                control_value: int = 1) -> Column:
    """``controle`` / ``oot`` / ``treino`` for each row."""
    return (F.when(F.col(control).cast("int") == control_value, "controle")
            .when(oot_flag(vintage, oot) == 1, OOT).otherwise(TRAIN))


def remove_control(tables: Mapping[str, DataFrame], column: str = K.CONTROL, value: int = 1):
    """Tables without the control group, and the control group as ``<table>_gc``."""
    kept, control = {}, {}
    for name, df in tables.items():
        _require(df, name, column)
        c = F.col(column).cast("int")
        control[f"{name}_gc"] = df.where(c == value)
        kept[name] = df.where(c.isNull() | (c != value))
    return kept, control


def split_train_oot(tables: Mapping[str, DataFrame], oot: Sequence[int] = K.OOT_VINTAGES,
                    vintage: str = K.VINTAGE) -> Splits:
    """Out-of-time vintages against all others (a null vintage counts as train)."""
    out: Splits = {}
    for name, df in tables.items():
        _require(df, name, vintage)
        flag = oot_flag(vintage, oot)
        out[name] = {TRAIN: df.where(flag == 0), OOT: df.where(flag == 1)}
    return out


def split_counts(tables: Mapping[str, DataFrame], oot: Sequence[int] = K.OOT_VINTAGES,
                 vintage: str = K.VINTAGE, control: str = K.CONTROL) -> DataFrame:
    """Rows per table and split, in one aggregation for all tables."""
    parts = [df.select(F.lit(name).alias("table_name"), split_label(vintage, control, oot).alias("split"))
             for name, df in tables.items()]
    return (reduce(DataFrame.unionByName, parts).groupBy("table_name", "split")
            .agg(F.count("*").alias("n_rows")))


def prepare(tables: Mapping[str, DataFrame], oot: Sequence[int] = K.OOT_VINTAGES, vintage: str = K.VINTAGE,
            control: str = K.CONTROL):
    """Control removal, split and per-table counts: (splits, counts, control tables)."""
    kept, gc = remove_control(tables, control)
    return split_train_oot(kept, oot, vintage), split_counts(tables, oot, vintage, control), gc


# --- samples -----------------------------------------------------------------

def _hash(key: str, seed: int) -> Column:
    """Hexadecimal hash of seed and key, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _below(key: str, fraction: Column | float, seed: int) -> Column:
    """Whether the key's hash, read as a number between 0 and 1, is below the fraction."""
    head = F.conv(F.substring(_hash(key, seed), 1, 8), 16, 10).cast("long")
    return head < F.round(F.lit(fraction) * 16 ** 8)


def sample_train(splits: Splits, fraction: float, key: str = K.ID, seed: int = K.SEED) -> Splits:
    """Sample of the train side by the hash of the key; the out-of-time side stays whole.

    The rows depend on the key and the seed alone, not on the layout of the table or the size of the cluster.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    if fraction == 1:
        return splits
    return {t: {**s, TRAIN: sample_hashed(s[TRAIN], key, fraction, seed)} for t, s in splits.items()}


def sample_stratified(df: DataFrame, target: str, fraction: float | Mapping, key: str = K.ID, seed: int = K.SEED) -> DataFrame:
    """Sample by target class, by the hash of the key; rows without a target are left out.

    A number applies to every class, a mapping gives the fraction per class; a class it does not name is left out.
    """
    known = df.where(F.col(target).isNotNull())
    if not isinstance(fraction, Mapping):
        return sample_hashed(known, key, fraction, seed)
    kept = F.lit(False)
    for value, part in fraction.items():
        kept = kept | ((F.col(target) == value) & _below(key, part, seed))
    return known.where(kept)


def sample_hashed(df: DataFrame, key: str, fraction: float, seed: int = K.SEED) -> DataFrame:
    """Sample that depends only on the key: stable under any partitioning and reproducible elsewhere."""
    return df if fraction >= 1 else df.where(_below(key, fraction, seed))


#: Hexadecimal digits that one pass of the capped sample tells apart, and rows that may be left to sort at its end.
_DIGITS, _LEFT = 4, 10_000


def sample_capped(df: DataFrame, key: str, size: int, seed: int = K.SEED) -> DataFrame:
    """At most ``size`` rows, those with the smallest key hashes (null keys first, ties by key).

    The hash that ends the sample is found by counting: a pass counts rows by the next digits inside the one range that
    is left, until few rows lie in it. All smaller hashes are kept by a filter; only the rows of the last range are sorted.
    """
    if size <= 0:
        return df.limit(0)
    hashed = df.withColumn("__hash", F.coalesce(_hash(key, seed), F.lit("")))
    start, wanted = "", size
    while True:
        digits = len(start) + _DIGITS
        head = F.substring("__hash", 1, digits)
        counts = hashed.where(F.col("__hash").startswith(start)).groupBy(head.alias("h")).count().collect()
        for r in sorted(counts, key=lambda r: r["h"]):
            if r["count"] >= wanted:
                last, n = r["h"], r["count"]
                break
            wanted -= r["count"]
        else:
            return df  # fewer rows than asked for
        if n == wanted or n <= _LEFT or len(last) < digits or digits >= 32:
            break
        start = last
    inside = F.substring("__hash", 1, len(last)) == last if last else F.col("__hash") == ""
    below = hashed.where(F.col("__hash") < last) if last else hashed.limit(0)
    rest = hashed.where(inside)
    if n > wanted:
        rest = rest.orderBy("__hash", F.col(key)).limit(wanted)
    return below.unionByName(rest).drop("__hash")
