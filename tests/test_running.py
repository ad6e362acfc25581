import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmart.operators import running


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_a_plain_cumulative_sum(spark, ranges, descending):
    rnd = random.Random(ranges)
    rows = [(g, float(x), rnd.randrange(10)) for g in ("a", None) for x in rnd.sample(range(-500, 500), 120)]
    df = spark.createDataFrame(rows, "g string, x double, n int")
    got = {(r.g, r.x): (r.cum_n, r.tot_n) for r in running.running_totals(df, "x", ["n"], by=["g"], descending=descending, ranges=ranges).collect()}
    want = {}
    for g in ("a", None):
        cum, mine = 0, sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=descending)
        for r in mine:
            cum += r[2]
            want[(g, r[1])] = (cum, sum(q[2] for q in mine))
    assert got == want


@pytest.mark.parametrize("ranges", [1, 5])
@pytest.mark.parametrize("n", [1, 2, 11, 500])
def test_exact_quantiles_match_linear_interpolation(spark, n, ranges):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n) * 3, 1)
    probs = [0, 0.1, 0.25, 0.5, 0.77, 1]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    row = running.exact_quantiles(df, "x", probs, ranges=ranges).first()
    np.testing.assert_allclose(list(row), np.quantile(x, probs), atol=1e-12)


def test_row_positions_break_ties_by_id(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([0.5, 0.5, 0.5, rnd.random()])) for i in range(400)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, p double")
    got = {r.id: r.position for r in running.row_positions(df, "p", "id").collect()}
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert got == want


def test_positions_on_text_keys_with_one_hot_score(spark):
    rnd = random.Random(6)
    rows = [(f"k{rnd.random():.12f}", 0.5 if i % 10 else rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "ID_UNICO string, p double")
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    for parts in (1, 7):
        out = running.row_positions(df.repartition(parts), "p", "ID_UNICO")
        assert {r.ID_UNICO: (r.position, r.n_rows) for r in out.collect()} == {i: (k, 3000) for i, k in want.items()}
    assert out.columns == ["ID_UNICO", "p", "position", "n_rows"]
    assert running.row_positions(df.limit(0), "p", "ID_UNICO").count() == 0


def test_a_hot_score_is_spread_over_tasks(spark):
    """A score shared by nine tenths of the rows is sorted by many tasks."""
    df = spark.range(60_000).select("id", F.when(F.col("id") % 10 > 0, F.lit(0.5)).otherwise(F.rand(1)).alias("p"))
    sizes = [r[0] for r in df.repartitionByRange(20, F.col("p").desc(), "id").where("p = 0.5").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) >= 17 and max(sizes) < 2 * 60_000 / 20


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, n int")
    assert running.running_totals(df, "x", ["n"]).count() == 0
    assert running.exact_quantiles(df, "x", [0.5]).first()[0] is None
