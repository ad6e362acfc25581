"""Global running totals and exact quantiles without a single-task window.

A window ordered over a whole table runs in one task. Here the order column is cut
into value ranges first: each range gets its own running sum, and the (tiny) table
of range totals supplies the offset of everything before it. The number of ranges
is bounded, so the only unpartitioned step works on at most that many rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.session import parts, stored

MAX_RANGES = 10_000
_RANGE = "__range"


def range_cuts_of(df: DataFrame, orders: Sequence[Column], ranges: int | None = None) -> list[list[float]]:
    """Approximate quantiles of several order columns, to be used as range bounds.

    This is the one eager step: a single job with mergeable sketches that returns at
    most ``ranges`` numbers per column. They become constants of the plan, so a
    recomputed task cuts the data at the same places.
    """
    if ranges is None:
        ranges = parts(df.sparkSession)
    ranges = max(1, min(ranges, MAX_RANGES // len(orders)))
    if ranges == 1:
        return [[] for _ in orders]
    probs = [i / ranges for i in range(1, ranges)]
    row = df.agg(*[F.percentile_approx(o.cast("double"), probs, max(1000, 10 * ranges)).alias(f"q{i}")
                   for i, o in enumerate(orders)]).first()
    return [sorted({x + 0.0 for x in (q or []) if x == x and abs(x) != float("inf")}) for q in row]


def range_cuts(df: DataFrame, order: Column, ranges: int | None = None) -> list[float]:
    return range_cuts_of(df, [order], ranges)[0]


def shared_cuts(df: DataFrame, orders: Sequence[Column], ranges: int | None = None) -> list[float]:
    """One set of bounds that splits each of several columns evenly."""
    return sorted({x for cuts in range_cuts_of(df, orders, ranges) for x in cuts})


def with_range(df: DataFrame, order: Column, cuts: Sequence[float], name: str = _RANGE) -> DataFrame:
    """Number of the value range each row falls in."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    key = name + "_x"
    splits = [-float("inf"), *cuts, float("inf")]
    out = Bucketizer(splits=splits, inputCol=key, outputCol=name, handleInvalid="keep").transform(
        df.withColumn(key, order.cast("double")))
    return out.withColumn(name, F.col(name).cast("int")).drop(key)


def _direction(name: str, descending: bool) -> Column:
    return F.col(name).desc() if descending else F.col(name).asc()


def _range_offsets(ranged: DataFrame, sums: Mapping[str, Column], by: Sequence[str], descending: bool) -> DataFrame:
    """Per group and range: what the earlier ranges sum to, and the group total.

    One row per (group, range), so the windows see at most the number of ranges.
    """
    parts = ranged.groupBy(*by, _RANGE).agg(*[F.sum(c).alias(f"__s_{s}") for s, c in sums.items()])
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy(_direction(_RANGE, descending)).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(
        *by, _RANGE,
        *[F.coalesce(F.sum(f"__s_{s}").over(before), F.lit(0)).alias(f"__add_{s}") for s in sums],
        *[F.sum(f"__s_{s}").over(whole).alias(f"tot_{s}") for s in sums])


def _running(ranged: DataFrame, offsets: DataFrame, order: str, sums: Mapping[str, Column], by: Sequence[str],
             descending: bool, columns: Sequence[str]) -> DataFrame:
    """Running sums inside each range, started by the range's offset row.

    The offset rows are stacked under the data and sort first in their range: the big
    side is shuffled once, and nothing is joined.
    """
    rows = ranged.withColumns({f"__add_{s}": c for s, c in sums.items()}).withColumn("__first", F.lit(1))
    heads = offsets.withColumn("__first", F.lit(0))
    both = rows.unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy(*by, _RANGE).orderBy("__first", _direction(order, descending)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = both.select(
        *columns, "__first",
        *[F.sum(f"__add_{s}").over(w).alias(f"cum_{s}") for s in sums],
        *[F.first(f"tot_{s}").over(w).alias(f"tot_{s}") for s in sums])
    return out.where(F.col("__first") == 1).drop("__first")


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    cuts: Sequence[float] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``cum_<s>`` (inclusive running sum) and ``tot_<s>`` (group total) columns.

    ``order`` must be numeric, not null and unique inside a group; collapse ties with
    a ``groupBy`` before calling.
    """
    if cuts is None:
        cuts = range_cuts(df, F.col(order), ranges)
    ranged = with_range(df, F.col(order), cuts)
    added = {s: F.col(s) for s in sums}
    offsets = _range_offsets(ranged, added, by, descending)
    return _running(ranged, offsets, order, added, by, descending, df.columns)


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values with their row counts."""
    return df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))


def exact_quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    ranges: int | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group.

    Works on the distinct values with their counts: ties collapse before the
    shuffle and no task holds a whole group.
    """
    names = list(names or [f"q{i}" for i in range(len(probabilities))])
    counts = value_counts(df, column, by)
    cuts = range_cuts(df, F.col(column), ranges) if cuts is None else cuts
    curve = running_totals(counts, column, ["n"], by=by, cuts=cuts)

    def at(index: Column) -> Column:
        inside = (F.col("cum_n") - F.col("n") <= index) & (index < F.col("cum_n"))
        return F.max(F.when(inside, F.col(column).cast("double")))

    aggs = []
    for i, q in enumerate(probabilities):
        h = (F.col("tot_n") - 1) * F.lit(float(q))
        aggs += [at(F.floor(h)).alias(f"__lo{i}"), at(F.ceil(h)).alias(f"__hi{i}"),
                 F.max(h - F.floor(h)).alias(f"__f{i}")]
    out = curve.groupBy(*by).agg(*aggs)
    return out.select(*by, *[
        (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(n)
        for i, n in enumerate(names)])


def row_positions(df: DataFrame, score: str, tie: str, descending: bool = True) -> DataFrame:
    """Add ``position`` (1..n by score, ties by ascending ``tie``) and ``n_rows``.

    Rows are sorted in ranges of (score, tie), so a score shared by a large part of the table is spread by its ties,
    and stored; each range then starts from the number of rows before it. One shuffle of the data, one number for each
    range on the driver. ``tie`` may have any sortable type and must be unique; null scores come last.
    """
    order = [F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last(), F.col(tie).asc()]
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
                    .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "positions")
    start, offsets = 0, []
    for part, n in sorted(tuple(r) for r in ranged.groupBy("__part").count().collect()):
        offsets.append((part, start))
        start += n
    known = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part int, __start long")
    return ranged.join(F.broadcast(known), "__part").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("__start") + F.col("__at") + 1).alias("position"),
        F.lit(start).cast("long").alias("n_rows"))
