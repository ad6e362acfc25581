import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskmart.operators import metrics as M


def frame(spark, rows):
    return spark.createDataFrame(rows, "y int, p double, f int")


def brute(rows):
    """KS, threshold and AUC by direct enumeration."""
    bad = [p for y, p, _ in rows if y == 1]
    good = [p for y, p, _ in rows if y == 0]
    pairs = sum(1.0 if b > g else 0.5 if b == g else 0.0 for b in bad for g in good)
    best = max(((abs(sum(b >= t for b in bad) / len(bad) - sum(g >= t for g in good) / len(good)), t) for t in {p for _, p, _ in rows}))
    return best[0] * 100, best[1], pairs / (len(bad) * len(good))


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize("seed", range(6))
def test_ks_auc_gini_against_enumeration(spark, seed):
    rnd = random.Random(seed)
    levels = rnd.choice([2, 5, 1000])
    rows = [(int(rnd.random() < 0.3), rnd.randrange(levels) / levels, rnd.randrange(2)) for _ in range(160)]
    df = frame(spark, rows)
    ks, t, auc = brute(rows)
    got = one(M.ks(df, "y", "p", ranges=rnd.choice([1, 3, 16])))
    assert got["ks"] == pytest.approx(ks, abs=1e-9) and got["ks_threshold"] == t
    got = one(M.auc_gini(df, "y", "p"))
    assert got["auc"] == pytest.approx(auc, abs=1e-12) and got["gini"] == pytest.approx((2 * auc - 1) * 100, abs=1e-9)
    full = one(M.evaluate(df, "y", "p", flag="f"))
    pred = [int(p >= t) for _, p, _ in rows]
    count = lambda y, m: sum(r[0] == y and q == m for r, q in zip(rows, pred))
    assert (full["tn"], full["fp"], full["fn"], full["tp"]) == (count(0, 0), count(0, 1), count(1, 0), count(1, 1))
    direct = one(M.swap(df.withColumn("m", (F.col("p") >= t).cast("int")), "y", "m", "f"))
    assert {k: full[k] for k in direct} == direct


def test_perfect_reversed_and_all_ties(spark):
    perfect = frame(spark, [(1, 0.9, 0), (1, 0.8, 0), (0, 0.2, 1)])
    assert one(M.evaluate(perfect, "y", "p"))["ks"] == 100 and one(M.auc_gini(perfect, "y", "p"))["auc"] == 1
    backwards = frame(spark, [(0, 0.9, 0), (1, 0.1, 0)])
    assert one(M.auc_gini(backwards, "y", "p"))["auc"] == 0
    r = one(M.direction_free_auc(backwards, "y", ["p"]))
    assert (r["auc"], r["reversed"]) == (1.0, True)
    ties = frame(spark, [(0, 0.5, 0), (1, 0.5, 1), (1, 0.5, 1)])
    r = one(M.evaluate(ties, "y", "p"))
    assert (r["ks"], r["auc"], r["ks_threshold"], r["tp"], r["fp"]) == (0, 0.5, 0.5, 2, 1)


def test_one_class_falls_back(spark):
    r = one(M.evaluate(frame(spark, [(0, 0.7, 1), (0, 0.2, 0)]), "y", "p", flag="f"))
    assert (r["ks"], r["threshold"], r["auc"], r["tn"], r["fp"], r["recall"], r["swap_out_total"]) == (0, 0.5, None, 1, 1, 0, 1)


def test_threshold_is_inclusive_and_zero_denominators(spark):
    cm = M.rates_of_confusion(M.confusion(frame(spark, [(1, 0.5, 0), (0, 0.49, 0)]), "y", "p", 0.5)).first()
    assert (cm.tp, cm.tn, cm.accuracy, cm.f1_score) == (1, 1, 1.0, 1.0)
    none = M.rates_of_confusion(M.confusion(frame(spark, [(0, 0.1, 0)]), "y", "p", 0.5)).first()
    assert (none.precision, none.recall, none.f1_score) == (0, 0, 0)


def test_swap_has_all_quadrants(spark):
    rows = list(itertools.product((0, 1), (0.0, 1.0), (0, 1)))
    r = one(M.swap(frame(spark, rows).withColumn("m", F.col("p").cast("int")), "y", "m", "f"))
    assert (r["swap_in_total"], r["swap_in_good"], r["swap_in_hit_pct"], r["swap_out_bad"], r["kept_approved"], r["n_rows"]) == (2, 1, 50.0, 1, 2, 8)
    empty = one(M.swap(frame(spark, [(0, 0.0, 1)]).withColumn("m", F.lit(0)), "y", "m", "f"))
    assert (empty["swap_in_total"], empty["swap_in_hit_pct"], empty["swap_out_hit_pct"]) == (0, 0.0, 0.0)


def test_validation(spark):
    M.validate(frame(spark, [(0, 0.5, 1)]), "y", "p", "f", 0.5)
    for rows in ([(2, 0.5, 1)], [(None, 0.5, 1)], [(1, None, 1)], [(1, float("nan"), 1)], [(1, 0.5, 3)], []):
        with pytest.raises(ValueError):
            M.validate(frame(spark, rows), "y", "p", "f")
    with pytest.raises(ValueError, match="threshold"):
        M.validate(frame(spark, [(0, 0.5, 1)]), "y", "p", threshold=1.5)


def test_by_vintage_skips_single_class(spark):
    df = spark.createDataFrame([(1, 1, .9, 0), (1, 0, .1, 0), (2, 0, .3, 1), (3, 1, .2, 1), (3, 0, .7, 1)], "v int, y int, p double, o int")
    rows = M.by_vintage(df, "y", "p", "v", "o").collect()
    assert [(r.v, r.volume, r.bad_rate_pct, r.ks, r.base) for r in rows] == [(1, 2, 50.0, 100.0, "Treino"), (3, 2, 50.0, 100.0, "OOT (Teste)")]


def test_simulation_splits_at_the_floor(spark):
    df = spark.createDataFrame([(i, int(i < 3), 1.0 - i / 10) for i in range(10)], "id bigint, y int, p double")
    r = M.simulate_cutoff(df, "y", "p", "id", [0.25], 16.0).first()
    assert (r.n_rejected, r.rejected_rate_pct, r.approved_rate_pct) == (2, 100.0, 12.5)
    assert r.reduction_points == pytest.approx(3.5)
    out = {x.id for x in M.reject_worst(df, "p", "id", 0.25).where("rejected = 1").collect()}
    assert out == {0, 1}


def test_delta_and_comparison_join_on_step(spark):
    a = spark.createDataFrame([(2, 30.0), (1, 20.0)], "etapa int, ks double")
    b = spark.createDataFrame([(1, 25.0), (2, 28.0)], "etapa int, ks double")
    long = M.with_delta(M.stack_records({"lr": a})).orderBy("etapa").collect()
    assert [(r.ks_anterior, r.delta_ks) for r in long] == [(0.0, 20.0), (20.0, 10.0)]
    assert [tuple(r) for r in M.compare_models(a, b).orderBy("etapa").collect()] == [(1, 20.0, 25.0, 5.0), (2, 30.0, 28.0, -2.0)]
