import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.operators import history as H
from riskmart.operators import pivot


def spine(spark, rows):
    df = spark.createDataFrame(rows, "NUM_CPF string, SAFRA int")
    return H.spine(df.withColumn(K.ID, F.concat("NUM_CPF", F.col("SAFRA").cast("string"))))


def events(spark, rows):
    return spark.createDataFrame(rows, "c string, d date, v int, item string, grp string, seq int")


def ev(c, day, v=1, item="p", grp="g", seq=1):
    return (c, dt.date.fromisoformat(day), v, item, grp, seq)


def rollup(e):
    return H.daily_rollup(e, "c", "d", {"n": F.count("*"), "v": F.sum(F.col("v").cast("decimal(18,2)")), "vmax": F.max("v")})


def test_only_days_strictly_before_the_cutoff(spark):
    s = spine(spark, [("a", 202402), ("a", 202403), ("b", 202402), (None, 202402)])
    e = events(spark, [ev("a", "2024-01-31", 5), ev("a", "2024-02-01", 7), ev("a", "2024-02-02", 9), ev("zz", "2020-01-01")])
    rows = {r[K.ID]: (r.n, float(r.v), r.vmax, r.rec) for r in H.book(s, rollup(e), {
        "n": H.total("n"), "v": H.amount("v"), "vmax": H.peak("vmax"), "rec": H.recency()}).collect()}
    assert rows == {"a202402": (1, 5.0, 5, 1), "a202403": (3, 21.0, 9, 28)}
    joined = H.events_before(s, e, "c", "d", spine_customer=K.CUSTOMER)
    assert joined.groupBy(K.ID).count().orderBy(K.ID).collect() == [("a202402", 1), ("a202403", 3)]


def test_recency_windows_at_their_limits(spark):
    s = spine(spark, [("a", 202406)])
    cut = dt.date(2024, 6, 1)
    days = [1, 30, 31, 90, 91]
    e = events(spark, [ev("a", (cut - dt.timedelta(x)).isoformat(), x) for x in days])
    r = H.book(s, rollup(e), {"n30": H.total("n", upto=30), "n90": H.total("n", after=30, upto=90), "n": H.total("n"),
                              "v30": H.amount("v", upto=30), "v90": H.amount("v", after=30, upto=90)}).first()
    assert (r.n30, r.n90, r.n, float(r.v30), float(r.v90)) == (2, 2, 5, 31.0, 121.0)


def test_empty_window_is_zero(spark):
    s = spine(spark, [("a", 202406)])
    r = H.book(s, rollup(events(spark, [ev("a", "2020-01-01")])), {"n30": H.total("n", upto=30), "v30": H.amount("v", upto=30)}).first()
    assert (r.n30, float(r.v30)) == (0, 0.0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_direct_computation(spark, seed):
    """A third of the events belong to one customer."""
    rnd = random.Random(seed)
    vintages = [202401, 202403, 202404, 202407]
    customers = [f"c{i}" for i in range(12)]
    rows = []
    for _ in range(900):
        c = "c0" if rnd.random() < 1 / 3 else rnd.choice(customers)
        rows.append((c, dt.date(2023, 11, 1) + dt.timedelta(rnd.randrange(260)), rnd.randrange(100),
                     rnd.choice(["x", "y", "z", "w", None]), f"g{rnd.randrange(4)}", rnd.choice([None, 1, 2, 5, 9])))
    e = events(spark, rows)
    s = spine(spark, [(c, v) for c in customers for v in vintages])
    daily = H.stack_daily(rollup(e), H.daily_first_seen(e, "c", "d", "item", "items"),
                          H.daily_peak_growth(e, "c", "d", "grp", F.col("seq"), "seqs"))
    got = {r[K.ID]: tuple(r)[3:] for r in H.book(s, daily, {
        "n": H.total("n"), "v": H.amount("v").cast("bigint"), "vmax": H.peak("vmax"), "rec": H.recency(),
        "items": H.total("items"), "seqs": H.total("seqs"), "n30": H.total("n", upto=30),
        "v90": H.amount("v", after=30, upto=90).cast("bigint")}).collect()}
    want = {}
    for c in customers:
        for v in vintages:
            cut = dt.date(v // 100, v % 100, 1)
            mine = [r for r in rows if r[0] == c and r[1] < cut]
            if not mine:
                continue
            ago = [(cut - r[1]).days for r in mine]
            peaks = {}
            for r in mine:
                if r[5] is not None:
                    peaks[r[4]] = max(peaks.get(r[4], 0), r[5])
            want[f"{c}{v}"] = (len(mine), sum(r[2] for r in mine), max(r[2] for r in mine), min(ago),
                               len({r[3] for r in mine} - {None}), sum(peaks.values()), sum(a <= 30 for a in ago),
                               sum(r[2] for r, a in zip(mine, ago) if 30 < a <= 90))
    assert got == want


def test_hot_customer_is_reduced_before_the_window(spark):
    """However many events a customer has, at most one row per day reaches the sort."""
    e = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("c"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 31).cast("int")).alias("d"), F.lit(1).alias("v"))
    daily = rollup(e)
    assert daily.where(F.col(H.CUSTOMER) == "hot").count() <= 31
    assert daily.agg(F.sum("n")).first()[0] == 200_000


def test_pivots(spark):
    df = spark.createDataFrame([("a", "PRÉ-PAGO"), ("a", "PRÉ PAGO"), ("a", None), ("b", "X"), ("c", None)], "k string, c string")
    rows = {r.k: tuple(r)[1:] for r in pivot.pivot_counts(df, "k", "c", "T").collect()}
    assert pivot.pivot_counts(df, "k", "c", "T").columns == ["k", "QTD_T_PR_PAGO", "QTD_T_X"]
    assert rows == {"a": (2, 0), "b": (0, 1), "c": (0, 0)}
    flags = {r.k: tuple(r)[1:] for r in pivot.pivot_flags(df, "k", "c", "T", ["X"]).collect()}
    assert flags == {"a": (0,), "b": (1,), "c": (0,)}
    with pytest.raises(ValueError, match="domain"):
        pivot.discover_domain(spark.range(20), "id", max_size=10)


def test_maps_beyond_the_columns(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("k"), F.concat(F.lit("v"), F.col("id") % 5000).alias("c"), F.col("id"))
    out = pivot.pivot_counts(df, "k", "c", "T")
    assert out.columns == ["k", "QTD_T"] and out.agg(F.sum(F.size("QTD_T"))).first()[0] == df.select("k", "c").distinct().count()
    assert out.select(F.explode("QTD_T")).agg(F.sum("value")).first()[0] == 20_000
    flags = pivot.pivot_flags(df, "k", "c", "T", max_size=10).select(F.explode("FLG_T")).select("value").distinct().collect()
    assert [r.value for r in flags] == [1]
    narrow = pivot.pivot_counts(df, "k", "c", "T", max_size=5000)
    assert len(narrow.columns) == 5001


def test_domains_of_many_columns_in_one_job(spark):
    df = spark.createDataFrame([("x", 1, None), ("y", None, None), (None, 2, None), ("x", 10, None)], "a string, b int, c string")
    assert pivot.discover_domains(df, ["a", "b", "c"]) == {c: pivot.discover_domain(df, c) for c in "abc"}
    assert pivot.discover_domains(df, ["b"]) == {"b": [1, 10, 2]} and pivot.discover_domains(df, []) == {}
    with pytest.raises(ValueError, match="id"):
        pivot.discover_domains(spark.range(20).withColumn("z", F.lit("z")), ["z", "id"], max_size=10)


def test_a_hot_customer_meets_its_cutoffs_month_by_month(spark):
    """A third of all events belongs to one customer: same rows as the plain join, and no task far above the others."""
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 720).cast("int"))
    e = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("c"), (F.xxhash64("id") % 400).cast("string"))).alias("c"), day.alias("d"))
    e = e.union(spark.createDataFrame([(-1, "hot", None), (-2, None, dt.date(2023, 1, 5))], "id long, c string, d date"))
    who = e.select("c").distinct().union(spark.createDataFrame([("none",)], "c string"))
    spine = H.spine_at(who, "c", {202305: "2023-05-01", 202402: "2024-02-17", 202412: "2024-12-31", 202201: "2022-01-01"})
    plain = H.events_before(spine, e, "c", "d", spine_customer=K.CUSTOMER)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = H.events_before_by_month(spine, e, "c", "d", spine_customer=K.CUSTOMER)
        assert got.columns == plain.columns and got.count() == plain.count() > 0
        assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
        tasks = sorted(r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert tasks[-1] <= 3 * tasks[len(tasks) // 2]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    same = H.events_before_by_month(spine.withColumnRenamed(K.CUSTOMER, "c"), e, "c", "d")
    assert same.columns.count("c") == 1 and same.count() == plain.count()
    assert H.events_before_by_month(spine, e.limit(0), "c", "d", spine_customer=K.CUSTOMER).isEmpty()
