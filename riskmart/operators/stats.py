"""Correlations, proportion test, sampling simulation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.operators.running import (exact_quantiles, range_cuts, running_totals, shared_cuts,
                                        value_counts)

def correlation_with(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each column with the target, strongest first."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    return (row.unpivot([], list(columns), "variavel", "corr")
            .orderBy(F.col("corr").desc(), "variavel"))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair (lower triangle), long format; nulls leave pair by pair.

    One way for any number of columns: each task adds up counts, sums and products of all pairs as matrices of its
    rows, shifted by the column means, and one grouping adds the tasks. Null where a pair has no variation.
    """
    columns = list(columns)
    n = len(columns)
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    means = [v or 0.0 for v in wide.agg(*[F.avg(f"c{i}") for i in range(n)]).first()] if n else []

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, n, n))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]) - means
            known = np.column_stack([batch.column(i).is_valid().to_numpy(zero_copy_only=False) for i in range(n)]).astype(float)
            x = np.where(known == 1, x, 0.0)
            total += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        i, j = np.triu_indices(n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(v) for v in (
            total[0, i, j], total[1, i, j], total[1, j, i], total[2, i, j], total[2, j, i], total[3, i, j])]],
            names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    added = wide.mapInArrow(sums, "i int, j int, " + ", ".join(f"{c} double" for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))).groupBy(
        "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])

    def spread(s: str, q: str) -> Column:
        return F.col(q) - F.col(s) * F.col(s) / F.col("n")

    joint = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    names = F.array(*[F.lit(c) for c in columns])
    return added.select(F.element_at(names, F.col("i") + 1).alias("variavel_1"), F.element_at(names, F.col("j") + 1).alias("variavel_2"),
                        F.when((F.col("n") > 0) & (spread("sx", "sxx") > 0) & (spread("sy", "syy") > 0),
                               joint / F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))).alias("corr"))


def average_ranks(df: DataFrame, column: str, by: Sequence[str] = (), ranges: int | None = None,
                  cuts: Sequence[float] | None = None) -> DataFrame:
    """Average rank of each distinct value (ties share the mean of their positions)."""
    counts = value_counts(df, column, by)
    cuts = range_cuts(df, F.col(column), ranges) if cuts is None else cuts
    curve = running_totals(counts, column, ["n"], by=by, cuts=cuts)
    return curve.select(*by, column, "n", (F.col("cum_n") - (F.col("n") - 1) / 2).alias("rank"))


def ranked_columns(df: DataFrame, columns: Sequence[str], key: str, ranges: int | None = None) -> DataFrame:
    """Each column replaced by its average rank, one row per key.

    Ranks are computed on distinct values, so ties never pile up in one task; the
    join back is on (column, value), where a hot value is split by the adaptive
    skew join of the session.
    """
    wide = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot([key], list(columns), "__column", "__value")
    cuts = shared_cuts(wide, [F.col(c) for c in columns], ranges)
    ranks = average_ranks(long, "__value", by=["__column"], cuts=cuts).drop("n")
    return (long.join(ranks, ["__column", "__value"], "left")
            .groupBy(key).pivot("__column", list(columns)).agg(F.first("rank")))


def spearman_pairs(df: DataFrame, columns: Sequence[str], key: str, limit: float | None = None,
                   ranges: int | None = None) -> DataFrame:
    """Absolute Spearman correlation of column pairs, optionally only above a limit."""
    out = correlation_pairs(ranked_columns(df, columns, key, ranges), columns).select(
        "variavel_1", "variavel_2", F.abs("corr").alias("rho"))
    return out if limit is None else out.where(F.col("rho") > limit)


def collinear_columns(pairs: DataFrame, limit: float) -> DataFrame:
    """Columns strongly correlated with an earlier one."""
    return pairs.where(F.col("rho") > limit).select(F.col("variavel_2").alias("variavel")).distinct()


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value; only ever applied to one-row test results."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


def proportion_test(df: DataFrame, target: str, group: Column, level: float = 0.05) -> DataFrame:
    """Pooled two-proportion z-test of a group against the rest, as one row."""
    known = df.where(F.col(target).isNotNull()).select(F.col(target).alias("__y"), group.alias("__g"))
    sums = known.agg(
        F.sum(F.when(F.col("__g"), F.col("__y"))).alias("x1"), F.count_if(F.col("__g")).alias("n1"),
        F.sum(F.when(~F.col("__g"), F.col("__y"))).alias("x2"), F.count_if(~F.col("__g")).alias("n2"))
    p1, p2 = F.try_divide(F.col("x1"), F.col("n1")), F.try_divide(F.col("x2"), F.col("n2"))
    pooled = F.try_divide(F.col("x1") + F.col("x2"), F.col("n1") + F.col("n2"))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2"))))
    z = F.try_divide(p1 - p2, error)
    out = sums.select("x1", "n1", "x2", "n2", p1.alias("p1"), p2.alias("p2"), z.alias("z"))
    return out.withColumn("p_value", normal_two_sided(F.col("z"))).withColumn(
        "verdict", F.when(F.col("p_value") < level, "Significante (H0 Rejeitada)")
        .otherwise("Não Significante (Falha em rejeitar H0)"))


def binomial_simulation(df: DataFrame, target: str, group: Column, draws: int = 10_000, size: int = 250,
                        seed: int = 42) -> DataFrame:
    """Simulated mean target rate of ``size`` rows, for the group and for the rest.

    The two proportions come from the table as one row; each draw sums ``size``
    seeded Bernoulli trials in its own task.
    """
    rates = df.where(F.col(target).isNotNull()).agg(
        F.avg(F.when(group, F.col(target))).alias("p1"), F.avg(F.when(~group, F.col(target))).alias("p2"))
    p1, p2 = rates.select("p1").scalar(), rates.select("p2").scalar()
    trials = df.sparkSession.range(draws * size).select(
        F.floor(F.col("id") / size).alias("draw"), F.rand(seed).alias("u1"), F.rand(seed + 1).alias("u2"),
        p1.alias("p1"), p2.alias("p2"))
    return trials.groupBy("draw").agg(
        (F.count_if(F.col("u1") < F.col("p1")) / size).alias("mean_group"),
        (F.count_if(F.col("u2") < F.col("p2")) / size).alias("mean_rest"))


def simulation_limit(simulated: DataFrame, q: float = 0.95) -> DataFrame:
    """Share of the rest's simulated means below the significance limit: their q-quantile."""
    return exact_quantiles(simulated, "mean_rest", [q], names=["limit"])
