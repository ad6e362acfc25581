import pytest
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.operators import frames, profile, ranking, splits, stats


def test_attach_keeps_the_population_and_flags_misses_before_filling(spark):
    base = spark.createDataFrame([("1", 5), ("2", 6), ("3", 7)], "ID_UNICO string, x int")
    extra = spark.createDataFrame([("1", 9, 1, 2.5), ("2", 8, None, None)], "ID_UNICO string, x int, n int, var_a double")
    out = frames.attach(base, extra, probe="var_a", miss_flag="SEM",
                        fills=lambda names: frames.fill_plan(names, 0, prefixes={"var": -1}))
    rows = {r.ID_UNICO: (r.x, r.n, r.var_a, r.SEM) for r in out.collect()}
    assert rows == {"1": (5, 1, 2.5, 0), "2": (6, 0, -1.0, 1), "3": (7, 0, -1.0, 1)}


def test_fill_refuses_the_wrong_type(spark):
    df = spark.createDataFrame([("a", None)], "s string, n int")
    with pytest.raises(TypeError):
        frames.fill(df, {"s": -1})
    with pytest.raises(ValueError):
        frames.fill(df, {"zz": -1})
    assert frames.fill(df, {"n": -1}).first().n == -1


def test_fill_plan_priorities():
    plan = frames.fill_plan(["var_1", "a", "b", "c"], 0, prefixes={"var": -1}, named={-9999: ["b"], 7: ["var_1"]})
    assert plan == {"var_1": 7, "a": 0, "b": -9999, "c": 0}


def test_project_reports_missing_columns(spark):
    with pytest.raises(ValueError, match="zz"):
        frames.project(spark.range(1), ["id", "zz"])
    assert frames.new_columns(["k", "a"], ["a", "k", "b"], "k") == ["k", "b"]


def test_filters(spark):
    df = spark.createDataFrame([("NULA", -4), ("OK", 10), (None, 18), ("OK", 30)], "s string, IDADE int")
    assert frames.exclude_value(df, "s", "NULA").count() == 2
    assert [r.IDADE for r in frames.adults_or_unknown(df).collect()] == [-4, 18, 30]
    assert [r[0] for r in df.select(frames.not_in_list("s", ["OK"])).collect()] == [True, False, False, False]


def test_dimension_members_and_patch(spark):
    dim = spark.createDataFrame([(1, "a", 1), (-2, "b", 5), (-3, "c", 6)], "k int, t string, n int")
    out = frames.with_members(dim, [(-1, "NAO SE APLICA", -1)])
    assert out.count() == 4
    patched = {r.k: (r.t, r.n) for r in frames.patch_by_key(out, "k", {"t": {-2: "ND"}, "n": {-2: -2, -3: -3}}).collect()}
    assert patched == {1: ("a", 1), -2: ("ND", -2), -3: ("c", -3), -1: ("NAO SE APLICA", -1)}


def test_enrich_with_another_key_keeps_the_dimension_key(spark):
    fact = spark.createDataFrame([(1, "x"), (9, "y")], "f int, v string")
    dim = spark.createDataFrame([(1, "one", "drop")], "d int, t string, other string")
    rows = [tuple(r) for r in frames.enrich(fact, dim, ["t"], "f", "d").orderBy("v").collect()]
    assert rows == [("x", 1, "one"), ("y", None, None)]


def test_casts(spark):
    df = spark.createDataFrame([("1", "x", None)], "a string, b string, c string")
    out = frames.cast_group(df, {"int": ["a", "b"], "decimal(18,2)": ["c"]}, -4).first()
    assert (out.a, out.b, float(out.c)) == (1, -4, -4.0)
    assert dict(frames.decimals_to_double(df.select(F.col("a").cast("decimal(18,2)").alias("m"))).dtypes) == {"m": "double"}
    assert [tuple(r) for r in frames.texts_to_number(df, skip=["c"]).collect()] == [(1.0, None, None)]


def test_splits_and_counts(spark):
    df = spark.createDataFrame([(202501, 0), (202502, 0), (202503, 1), (None, None)], "SAFRA int, GRUPO_CONTROLE int")
    kept, gc = splits.remove_control({"t": df})
    assert kept["t"].count() == 3 and gc["t_gc"].count() == 1
    pair = splits.split_train_oot(kept)["t"]
    assert (pair["treino"].count(), pair["oot"].count()) == (2, 1)
    assert {tuple(r) for r in splits.split_counts({"t": df}).collect()} == {("t", "treino", 2), ("t", "oot", 1), ("t", "controle", 1)}
    with pytest.raises(ValueError, match="GRUPO_CONTROLE"):
        splits.remove_control({"t": df.drop("GRUPO_CONTROLE")})


def test_samples(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    pair = {"t": {"treino": df, "oot": df}}
    out = splits.sample_train(pair, 0.2, "id")["t"]
    again = splits.sample_train({"t": {"treino": df.repartition(50), "oot": df}}, 0.2, "id")["t"]
    assert out["treino"].exceptAll(again["treino"]).isEmpty() and again["treino"].exceptAll(out["treino"]).isEmpty()
    assert out["oot"].count() == 20_000 and 3500 < out["treino"].count() < 4500
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            splits.sample_train(pair, bad)
    assert splits.sample_train(pair, 1) is pair
    by_class = splits.sample_stratified(df.union(df.limit(5).select("id", F.lit(None).cast("int"))), "y", {0: 0.1, 1: 0.5}, "id")
    n = dict(by_class.groupBy("y").count().collect())
    assert set(n) == {0, 1} and 1300 < n[0] < 1700 and 2300 < n[1] < 2700
    hashed = splits.sample_hashed(df, "id", 0.3)
    assert hashed.count() == splits.sample_hashed(df.repartition(13), "id", 0.3).count() and 5500 < hashed.count() < 6500
    assert splits.sample_capped(df, "id", 100).count() == 100 and splits.sample_capped(df.limit(7), "id", 100).count() == 7


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 0, float("nan")), (None, 1, None)], "c string, y int, x double")
    nulls = {r.coluna: (r.qtd_nulos, r.pct_nulos) for r in profile.null_profile(df).collect()}
    assert nulls == {"x": (2, 66.67), "c": (1, 33.33), "y": (0, 0.0)}
    freq = [tuple(r) for r in profile.frequency(df, "c").collect()]
    assert freq == [("a", 2, 66.67), (None, 1, 33.33)]
    assert profile.null_profile(df.limit(0)).count() == 3
    empty = profile.compare(df.limit(0), df, "y").first()
    assert (empty.rows_1, empty.rate_1_pct, empty.rows_removed_pct) == (0, 0.0, 0.0)
    seg = {r.segment: (r.volume, r.rate_pct) for r in profile.segments(df.withColumn("z", F.lit(0)), ["y", "z"], "y").collect()}
    assert seg == {"y": (2, 100.0), "z": (0, 0.0)}
    u = profile.uniqueness(spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "k int, c string"), "k", "c").first()
    assert (u.n_rows, u.n_keys, u.n_customers, u.is_unique) == (3, 2, 2, False)


def test_deciles_with_few_values_and_only_sentinels(spark):
    few = spark.createDataFrame([(float(v), int(v > 2)) for v in (1, 1, 2, 3, -1)], "s double, y int")
    bins = profile.decile_bins(few, "s", "y", sentinel=-1).collect()
    assert [(r.bin, r.volume) for r in bins][0] == (0, 1)
    assert sum(r.volume for r in bins) == 5 and bins[1].lower == 1.0 and bins[-1].upper == 3.0
    only = profile.decile_bins(few.where("s = -1"), "s", "y", sentinel=-1).collect()
    assert [(r.bin, r.volume) for r in only] == [(0, 1)]
    same = profile.decile_bins(spark.createDataFrame([(5.0, 1), (5.0, 0)], "s double, y int"), "s", "y").collect()
    assert [(r.volume, r.rate_pct) for r in same] == [(2, 50.0)]


def test_histogram_includes_both_ends(spark):
    h = profile.histogram(spark.range(0, 101).select(F.col("id").cast("double").alias("x")), "x", 4).orderBy("bin").collect()
    assert [r.n for r in h] == [25, 25, 25, 26] and (h[0].lower, h[-1].upper) == (0.0, 100.0)


def test_rankings(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 3.0)], "f string, w double")
    assert [(r.f, r.ranking) for r in ranking.rank_by(df, "w", "f").orderBy("ranking").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    assert [r.acumulado for r in ranking.cumulative_share(df, "w", "f").orderBy("acumulado").collect()] == [3.0, 4.0, 5.0]


def test_correlations_do_not_depend_on_the_number_of_columns(spark):
    """Nulls leave pair by pair, also where every row has a null somewhere."""
    df = spark.range(300).select("id", *[F.when((F.col("id") + i) % 7 > 0, (F.col("id") * (i + 3)) % 17 + F.rand(i)).alias(f"c{i}") for i in range(35)],
                                 F.lit(3.0).alias("flat"), F.lit(None).cast("double").alias("none"))
    names = [f"c{i}" for i in range(35)] + ["flat", "none"]
    got = {(r[0], r[1]): r[2] for r in stats.correlation_pairs(df.repartition(5), names).collect()}
    few = {(r[0], r[1]): r[2] for r in stats.correlation_pairs(df, names[:4]).collect()}
    assert len(got) == 37 * 36 // 2 and all(abs(got[k] - v) < 1e-9 for k, v in few.items())
    want = df.agg(*[F.corr("c0", f"c{i}").alias(f"c{i}") for i in range(1, 35)]).first().asDict()
    assert all(abs(got["c0", c] - v) < 1e-9 for c, v in want.items())
    assert got["c0", "flat"] is None and got["flat", "none"] is None
    ranks = stats.spearman_pairs(df, names[:24], "id").collect()
    assert len(ranks) == 24 * 23 // 2 and all(r["rho"] is not None for r in ranks)


def test_proportion_test(spark):
    df = spark.createDataFrame([(1, 1)] * 30 + [(0, 1)] * 70 + [(1, 0)] * 15 + [(0, 0)] * 85, "y int, g int")
    r = stats.proportion_test(df, "y", F.col("g") == 1).first()
    assert abs(r.z - 2.5400025) < 1e-5 and abs(r.p_value - 0.0110844) < 1e-5 and r.verdict.startswith("Significante")
    sim = stats.binomial_simulation(df, "y", F.col("g") == 1, draws=400, size=50)
    m = sim.agg(F.avg("mean_group").alias("a"), F.avg("mean_rest").alias("b"), F.count("*").alias("n")).first()
    assert m.n == 400 and abs(m.a - 0.3) < 0.02 and abs(m.b - 0.15) < 0.02


def test_collinear(spark):
    df = spark.range(200).select("id", F.col("id").alias("a"), (F.col("id") * F.col("id")).alias("b"), F.rand(3).alias("c"))
    pairs = stats.spearman_pairs(df, ["a", "b", "c"], "id")
    assert [r[0] for r in stats.collinear_columns(pairs, K.COLLINEAR_LIMIT).collect()] == ["b"]


def test_quality_gates(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 0, None)], "k string, f int, g int")
    profile.require_unique(df, "k")
    profile.require_filled(df, ["k", "f"])
    profile.require_binary(df, ["f"])
    with pytest.raises(ValueError, match="repeated"):
        profile.require_unique(df.union(df), "k")
    with pytest.raises(ValueError, match="'g': 1"):
        profile.require_filled(df, ["f", "g"])
    with pytest.raises(ValueError, match="'g': 1"):
        profile.require_binary(df, ["f", "g"])
