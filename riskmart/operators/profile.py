"""Data-quality and population reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.functions.values import flag
from riskmart.operators.running import exact_quantiles, shared_cuts


def _share(count: Column, total: Column, places: int = 2) -> Column:
    return F.round((F.lit(100) * count).cast("decimal(28,9)") / total, places).cast("double")


def frequency(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Count and percentage per value, most frequent first.

    The total is a scalar subquery, so the distinct values never meet in one task.
    """
    total = df.agg(F.count("*").alias("n")).scalar()
    out = df.groupBy(column).agg(F.count("*").alias("qtd_absoluto"))
    out = out.withColumn("qtd_percentual", _share(F.col("qtd_absoluto"), total))
    out = out.orderBy(F.col("qtd_absoluto").desc(), F.col(column).asc())
    return out if top is None else out.limit(top)


def frequency_sql(spark: SparkSession, view: str, column: str) -> DataFrame:
    """The same table as SQL text over a view, identifiers passed as parameters."""
    return spark.sql(
        """
        SELECT IDENTIFIER(:c) AS value,
               count(*) AS qtd_absoluto,
               CAST(round(CAST(100 * count(*) AS DECIMAL(28,9))
                    / (SELECT count(*) FROM IDENTIFIER(:t)), 2) AS DOUBLE) AS qtd_percentual
        FROM IDENTIFIER(:t)
        GROUP BY 1
        ORDER BY qtd_absoluto DESC, value
        """, args={"c": column, "t": view})


def _long(row: DataFrame, id_columns: Sequence[str], names: Sequence[str], variable: str, value: str) -> DataFrame:
    return row.unpivot(list(id_columns), list(names), variable, value)


def null_profile(df: DataFrame) -> DataFrame:
    """Null (and NaN) count and percentage of every column in one scan."""
    def bad(f):
        c = F.col(f"`{f.name}`")
        empty = c.isNull()
        return empty | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else empty

    row = df.agg(F.count("*").alias("__rows"), *[F.count_if(bad(f)).alias(f.name) for f in df.schema])
    long = _long(row, ["__rows"], df.columns, "coluna", "qtd_nulos")
    return (long.select("coluna", "qtd_nulos",
                        F.when(F.col("__rows") > 0, _share(F.col("qtd_nulos"), F.col("__rows"))).alias("pct_nulos"))
            .orderBy(F.col("qtd_nulos").desc(), "coluna"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def compare(first: DataFrame, second: DataFrame, target: str) -> DataFrame:
    """Rows, columns and target rate of two tables, and the change between them, as one row."""
    both = first.select(F.lit(1).alias("__side"), F.col(target).cast("double").alias("__y")).unionByName(
        second.select(F.lit(2).alias("__side"), F.col(target).cast("double").alias("__y")))
    side = lambda i: F.col("__side") == i
    row = both.agg(*[x for i in (1, 2) for x in (
        F.count_if(side(i)).alias(f"rows_{i}"),
        F.coalesce(F.avg(F.when(side(i), F.col("__y"))), F.lit(0.0)).alias(f"rate_{i}"))])
    lost = F.col("rows_1") - F.col("rows_2")
    return row.select(
        "rows_1", F.lit(len(first.columns)).alias("columns_1"), F.round(F.col("rate_1") * 100, 4).alias("rate_1_pct"),
        "rows_2", F.lit(len(second.columns)).alias("columns_2"), F.round(F.col("rate_2") * 100, 4).alias("rate_2_pct"),
        lost.alias("rows_removed"),
        F.when(F.col("rows_1") != 0, _share(lost, F.col("rows_1"))).otherwise(F.lit(0.0)).alias("rows_removed_pct"),
        F.round((F.col("rate_1") - F.col("rate_2")) * 100, 4).alias("rate_change_points"))


def uniqueness(df: DataFrame, key: str, customer: str) -> DataFrame:
    """Rows against distinct keys and distinct customers.

    Each distinct count is a grouping of its own column, joined by one-row results.
    """
    keys = df.groupBy(key).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(key).alias("n_keys"))
    customers = df.select(customer).distinct().agg(F.count(customer).alias("n"))
    return keys.select("n_rows", "n_keys", customers.scalar().alias("n_customers"),
                       (F.col("n_rows") == F.col("n_keys")).alias("is_unique"))


def summary(df: DataFrame, columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """count, mean, stddev, min, quartiles and max per numeric column, quartiles exact.

    The moments come from one wide aggregate; only the quartiles look at single values,
    after equal values have been counted.
    """
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    row = wide.agg(*[x for i, c in enumerate(columns) for x in (
        F.count(c).alias(f"n{i}"), F.avg(c).alias(f"a{i}"), F.stddev_samp(c).alias(f"s{i}"),
        F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"))])
    moments = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("coluna"), F.col(f"n{i}").alias("count"), F.col(f"a{i}").alias("mean"),
                 F.col(f"s{i}").alias("stddev"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"))
        for i, c in enumerate(columns)])).alias("m")).select("m.*")
    cuts = shared_cuts(wide, [F.col(c) for c in columns], ranges)
    quartiles = exact_quantiles(wide.unpivot([], list(columns), "coluna", "valor"), "valor", [0.25, 0.5, 0.75],
                                by=["coluna"], names=["p25", "p50", "p75"], cuts=cuts)
    return moments.join(quartiles, "coluna", "left")


def category_rate(df: DataFrame, column: str, target: str) -> DataFrame:
    """Volume (rows with a target) and target rate in percent per category, by volume."""
    return (df.groupBy(column)
            .agg(F.count(target).alias("volume"),
                 (F.sum(target) / F.count(target) * 100).alias("rate_pct"))
            .orderBy(F.col("volume").desc(), column))


def crosstab_share(df: DataFrame, row: str, column: str, domain: Sequence, prefix: str = "pct_") -> DataFrame:
    """Row-normalised cross table in percent, with the row totals."""
    known = F.col(column).isNotNull()
    out = df.where(known).groupBy(row).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(column) == F.lit(v)).alias(f"{prefix}{v}") for v in domain])
    return out.select(row, "total", *[
        (F.col(f"{prefix}{v}") / F.col("total") * 100).alias(f"{prefix}{v}") for v in domain])


def segments(df: DataFrame, flags: Sequence[str], target: str, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Volume and target rate where each 0/1 column is 1 (segments may overlap).

    All segments come from one aggregation of the wide table.
    """
    row = df.agg(*[x for f in flags for x in (
        F.count_if(flag(F.col(f) == 1) == 1).alias(f"v_{f}"),
        F.avg(F.when(F.col(f) == 1, F.col(target))).alias(f"r_{f}"))])
    cells = F.explode(F.array(*[
        F.struct(F.lit((labels or {}).get(f, f)).alias("segment"), F.col(f"v_{f}").alias("volume"),
                 F.coalesce(F.col(f"r_{f}") * 100, F.lit(0.0)).alias("rate_pct")) for f in flags]))
    return row.select(cells.alias("s")).select("s.*").orderBy(F.col("volume").desc(), "segment")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def median(df: DataFrame, column: str, where: Column | None = None, ranges: int | None = None) -> DataFrame:
    """Exact median of a filtered column."""
    rows = df if where is None else df.where(where)
    return exact_quantiles(rows, column, [0.5], names=["median"], ranges=ranges)


def target_share(df: DataFrame, target: str) -> DataFrame:
    """Rows and share of each target value."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.groupBy(target).agg(F.count("*").alias("n_rows")).withColumn(
        "share_pct", F.col("n_rows") / total * 100)


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal-width bin counts and densities; the last bin includes the maximum."""
    x = F.col(column).cast("double")
    known = df.where(F.col(column).isNotNull())
    if low is None or high is None:
        lo = known.agg(F.min(x)).scalar() if low is None else F.lit(float(low))
        hi = known.agg(F.max(x)).scalar() if high is None else F.lit(float(high))
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
    marked = known.select(x.alias("__x"), lo.alias("__lo"), hi.alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    slot = F.least(F.floor((F.col("__x") - F.col("__lo")) / width), F.lit(bins - 1)).cast("int")
    inside = marked.where((F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi")))
    counted = inside.groupBy(slot.alias("bin")).agg(
        F.count("*").alias("n"), F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi"))
    total = Window.partitionBy(F.lit(0))
    return counted.select(
        "bin", (F.col("__lo") + F.col("bin") * width).alias("lower"),
        (F.col("__lo") + (F.col("bin") + 1) * width).alias("upper"), "n",
        (F.col("n") / F.sum("n").over(total) / width).alias("density"))


def decile_bins(df: DataFrame, score: str, target: str, sentinel=None, bins: int = 10,
                fallback_bins: int = 5, ranges: int | None = None) -> DataFrame:
    """Volume and target rate per score quantile bin, the sentinel kept in its own bin.

    Bins are right-closed and the first one includes the minimum. Equal edges merge;
    when the quantiles leave fewer than two edges, equal-width bins are used.
    """
    real = df if sentinel is None else df.where(F.col(score) != F.lit(sentinel))
    row = exact_quantiles(real, score, [i / bins for i in range(bins + 1)], ranges=ranges).first()
    # at most bins + 1 numbers reach the driver
    edges = sorted({v for v in (row or []) if v is not None})
    if len(edges) == 1:
        pad = abs(edges[0]) * 0.001 or 0.001
        low, high = edges[0] - pad, edges[0] + pad
        edges = [low + (high - low) * i / fallback_bins for i in range(fallback_bins + 1)]
    x = F.col(score).cast("double")
    slot = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        slot = F.when(x <= edges[i], F.lit(i)).otherwise(slot)
    if sentinel is not None:
        slot = F.when(F.col(score) == F.lit(sentinel), F.lit(0)).otherwise(slot)
    counted = df.where(F.col(score).isNotNull()).groupBy(slot.alias("bin")).agg(
        F.count(target).alias("volume"), (F.sum(target) / F.count(target) * 100).alias("rate_pct"))
    bound = lambda shift: F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("bin") + shift)
    lower = F.when(F.col("bin") > 0, bound(0)) if edges else F.lit(None).cast("double")
    upper = F.when(F.col("bin") > 0, bound(1)) if edges else F.lit(None).cast("double")
    return counted.select("bin", lower.alias("lower"), upper.alias("upper"), "volume", "rate_pct").orderBy("bin")


# --- quality gates -----------------------------------------------------------

def flag_domains(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Zeros, ones and anything else per flag column: every flag in one scan."""
    row = df.agg(*[x for i, f in enumerate(flags) for x in (
        F.count_if(F.col(f) == 0).alias(f"z{i}"), F.count_if(F.col(f) == 1).alias(f"o{i}"),
        F.count_if(F.col(f).isNull() | ~F.col(f).isin(0, 1)).alias(f"x{i}"))])
    cells = F.explode(F.array(*[
        F.struct(F.lit(f).alias("coluna"), F.col(f"z{i}").alias("n_zero"), F.col(f"o{i}").alias("n_one"),
                 F.col(f"x{i}").alias("n_other")) for i, f in enumerate(flags)]))
    return row.select(cells.alias("c")).select("c.*")


def require_unique(df: DataFrame, key: str) -> None:
    """Raise when a key occurs more than once (or is null)."""
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).count()
    if repeated:
        raise ValueError(f"{key}: {repeated} values are repeated or null")


def require_filled(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise when a column still has nulls."""
    bad = {r["coluna"]: r["qtd_nulos"] for r in null_profile(df.select(*columns)).where("qtd_nulos > 0").collect()}
    if bad:
        raise ValueError(f"nulls left: {bad}")


def require_binary(df: DataFrame, flags: Sequence[str]) -> None:
    """Raise when a flag column holds anything but 0 and 1."""
    bad = {r["coluna"]: r["n_other"] for r in flag_domains(df, flags).where("n_other > 0").collect()}
    if bad:
        raise ValueError(f"not binary: {bad}")
