"""Leakage-free history books: spine, daily rollup, and per-vintage aggregation.

Events are first reduced to one row per (customer, day). Every measure used by the
books is additive, or a maximum, over days, so all vintages of a customer read the
same reduced rows and raw events are never repeated per vintage; a customer that
owns a large share of the events shrinks to at most one row per day. Distinct
counts and sums of per-group maxima are made additive over days as well.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.functions.dates import vintage_start

DAY = "__day"
CUSTOMER = "__customer"
DAY_NUMBER = "__day_number"
EVENT_NUMBER = "__event_number"


def spine(population: DataFrame, key: str = K.ID, customer: str = K.CUSTOMER, vintage: str = K.VINTAGE) -> DataFrame:
    """One row per key with the cutoff date of its vintage."""
    return population.select(key, customer, vintage, vintage_start(vintage).alias(K.CUTOFF))


def spine_at(customers: DataFrame, customer: str, cutoffs: Mapping[int, str]) -> DataFrame:
    """Every customer at every listed vintage: vintage number -> cutoff date.

    A row-local explode of a literal list, not a join.
    """
    points = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(d).cast("date").alias("d")) for v, d in cutoffs.items()])
    at = customers.select(F.col(customer).alias(K.CUSTOMER), F.explode(points).alias("p"))
    return at.select(
        F.concat(F.col(K.CUSTOMER).cast("string"), F.col("p.v").cast("string")).alias(K.ID),
        K.CUSTOMER, F.col("p.v").alias(K.VINTAGE), F.col("p.d").alias(K.CUTOFF))


def events_before(spine_df: DataFrame, events: DataFrame, customer: str, event_day: str,
                  cutoff: str = K.CUTOFF, spine_customer: str | None = None) -> DataFrame:
    """Spine joined to its events dated strictly before the cutoff."""
    left = spine_customer or customer
    cond = (spine_df[left] == events[customer]) & (events[event_day] < spine_df[cutoff])
    out = spine_df.join(events, cond, "inner")
    return out.drop(events[customer]) if left == customer else out


def events_before_by_month(spine_df: DataFrame, events: DataFrame, customer: str, event_day: str,
                           cutoff: str = K.CUTOFF, spine_customer: str | None = None) -> DataFrame:
    """The rows of ``events_before``, with the events of a customer spread over their months.

    A spine row is carried to every month up to its cutoff in which its customer has events, and meets them there by
    (customer, month): a customer with a large part of all events fills as many tasks as it has months. Only the distinct
    pairs of customer and month, found with map-side combining, and the spine are joined by customer alone; events move
    once. Rows without a day, a cutoff or a customer meet nothing. Worth it where customers are uneven.
    """
    left = spine_customer or customer
    month = F.year(event_day) * 12 + F.month(event_day)
    known = events.where(F.col(event_day).isNotNull() & F.col(customer).isNotNull())
    months = known.groupBy(F.col(customer).alias("__customer"), month.alias("__month")).agg(F.min(event_day).alias("__first"))
    carried = spine_df.join(months, (F.col(left) == F.col("__customer")) & (F.col("__first") < F.col(cutoff))).drop("__first")
    # events under names of their own: both sides may come from one table
    named = {c: f"__event_{i}" for i, c in enumerate(events.columns)}
    placed = known.select(*[F.col(c).alias(n) for c, n in named.items()], month.alias("__event_month"))
    out = carried.join(placed, (F.col("__customer") == F.col(named[customer])) & (F.col("__month") == F.col("__event_month"))
                       & (F.col(named[event_day]) < F.col(cutoff)))
    return out.select(*spine_df.columns, *[F.col(n).alias(c) for c, n in named.items() if left != customer or c != customer])


def until(events: DataFrame, day: str, latest: str | None, year: str | None = None) -> DataFrame:
    """Events before the latest cutoff of interest; the filter reaches the scan.

    When the table carries the ``year`` partition column of ``day``, later years are
    pruned as whole partitions.
    """
    if latest is None:
        return events
    out = events.where(F.col(day) < F.lit(latest).cast("date"))
    if year is not None and year in events.columns:
        out = out.where(F.col(year).cast("int") <= int(latest[:4]))
    return out


def of_population(events: DataFrame, customer: str, spine_df: DataFrame) -> DataFrame:
    """Events of the customers in the spine.

    Worth it when the population is a small part of the customers in the facts: the
    rest then never reaches the rollup. Otherwise the book drops them by itself.
    """
    wanted = spine_df.select(F.col(K.CUSTOMER).alias("__wanted")).distinct()
    return events.join(wanted, F.col(customer) == F.col("__wanted"), "left_semi")


def daily_rollup(events: DataFrame, customer: str, day: str, measures: Mapping[str, Column]) -> DataFrame:
    """One row per customer and day with the given aggregates."""
    return (events.where(F.col(day).isNotNull())
            .groupBy(F.col(customer).alias(CUSTOMER), F.col(day).alias(DAY))
            .agg(*[c.alias(n) for n, c in measures.items()]))


def daily_first_seen(events: DataFrame, customer: str, day: str, item: str, name: str) -> DataFrame:
    """Items seen for the first time each day: their sum up to a date is the distinct count."""
    first = (events.where(F.col(day).isNotNull() & F.col(item).isNotNull())
             .groupBy(F.col(customer).alias(CUSTOMER), F.col(item).alias("__item"))
             .agg(F.min(day).alias(DAY)))
    return first.groupBy(CUSTOMER, DAY).agg(F.count("*").alias(name))


def daily_peak_growth(events: DataFrame, customer: str, day: str, group: str, value: Column, name: str) -> DataFrame:
    """Daily growth of each group's running maximum, summed over the customer's groups.

    Summed up to a date it equals the sum over groups of the maximum up to that date.
    """
    peaks = (events.where(F.col(day).isNotNull())
             .groupBy(F.col(customer).alias(CUSTOMER), F.col(group).alias("__group"), F.col(day).alias(DAY))
             .agg(F.max(value).cast("bigint").alias("__peak")))
    w = Window.partitionBy(CUSTOMER, "__group").orderBy(DAY)
    so_far = F.max("__peak").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    earlier = F.max("__peak").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grown = peaks.select(CUSTOMER, DAY, (so_far - F.coalesce(earlier, F.lit(0))).alias("__growth"))
    return grown.groupBy(CUSTOMER, DAY).agg(F.sum("__growth").alias(name))


def stack_daily(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Put daily frames with different measures under each other."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


# --- per-vintage aggregates over the daily rows -----------------------------
# Spine rows and daily rows of a customer are sorted together by day; a spine row
# reads its features from window frames that end the day before its cutoff.

def _frame(after: int | None = None, upto: int | None = None):
    """Days before the cutoff: all of them, or ``after < days <= upto``."""
    w = Window.partitionBy(CUSTOMER).orderBy(DAY_NUMBER)
    first = Window.unboundedPreceding if upto is None else -upto
    return w.rangeBetween(first, -1 if after is None else -(after + 1))


def total(name: str, after: int | None = None, upto: int | None = None) -> Column:
    """Sum of a daily count over the history, or over ``after < days <= upto``; 0 if none."""
    return F.coalesce(F.sum(name).over(_frame(after, upto)), F.lit(0)).cast("bigint")


def amount(name: str, after: int | None = None, upto: int | None = None) -> Column:
    """Exact decimal total of a money measure; a window without events gives 0."""
    s = F.sum(name).over(_frame(after, upto))
    if after is not None or upto is not None:
        s = F.coalesce(s, F.lit(0))
    return s.cast("decimal(28,2)")


def peak(name: str) -> Column:
    return F.max(name).over(_frame())


def recency() -> Column:
    """Days between the cutoff and the latest event before it."""
    return (F.col(DAY_NUMBER) - F.max(EVENT_NUMBER).over(_frame())).cast("int")


def book(spine_df: DataFrame, daily: DataFrame, features: Mapping[str, Column],
         key: str = K.ID, customer: str = K.CUSTOMER, vintage: str = K.VINTAGE,
         cutoff: str = K.CUTOFF) -> DataFrame:
    """Features of the days strictly before each cutoff, one row per key with any event.

    One shuffle by customer and one sort serve every feature and every vintage: days
    are not repeated per vintage, so the cost grows with days plus vintages.
    """
    points = spine_df.where(F.col(customer).isNotNull()).select(
        F.col(customer).alias(CUSTOMER), F.col(cutoff).alias(DAY), F.col(key).alias("__key"),
        F.col(vintage).alias("__vintage"))
    rows = points.unionByName(daily.where(F.col(CUSTOMER).isNotNull()), allowMissingColumns=True)
    number = F.unix_date(DAY)
    rows = rows.withColumns({DAY_NUMBER: number, EVENT_NUMBER: F.when(F.col("__key").isNull(), number)})
    seen = F.count(EVENT_NUMBER).over(_frame())
    out = rows.select(
        F.col("__key").alias(key), F.col(CUSTOMER).alias(customer), F.col("__vintage").alias(vintage),
        F.col(DAY).alias(cutoff), seen.alias("__seen"), *[c.alias(n) for n, c in features.items()])
    return out.where(F.col(key).isNotNull() & (F.col("__seen") > 0)).drop("__seen", cutoff)
