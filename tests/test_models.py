import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.models import estimators as E
from riskmart.models import importance as I
from riskmart.models import training as T
from riskmart.operators import metrics, splits
from riskmart.sources import writers


@pytest.fixture(scope="module")
def data(spark):
    """A separable target with a useless feature, nulls and a text number."""
    df = spark.range(3000).select(
        F.concat(F.lit("k"), "id").alias("ID_UNICO"), F.lit(0).alias("GRUPO_CONTROLE"),
        F.when(F.col("id") % 4 == 0, 202502).otherwise(202501).alias("SAFRA"),
        F.when(F.col("id") % 10 > 0, F.rand(1)).alias("good"), F.rand(2).alias("noise"),
        F.rand(3).cast("string").alias("words"), (F.col("id") % 2).cast("int").alias("FLAG_INSTALACAO"))
    df = df.withColumn("FPD", (F.coalesce("good", F.lit(0.5)) * 0.8 + F.rand(4) * 0.4 > 0.6).cast("int"))
    return df.cache()


@pytest.fixture(scope="module")
def pair(data):
    return splits.prepare({"score_01": data.drop("noise", "words"), "score_02": data})[0]


FEATURES = ["good", "noise", "words"]


@pytest.mark.parametrize("kind, params", [
    ("logistica", {}), ("gb", {"n_estimators": 5}), ("hist_gb", {"max_iter": 5, "max_bins": 32}), ("xgb", {"n_estimators": 5})])
def test_every_family_scores_and_separates(pair, kind, params):
    train, oot = pair["score_02"]["treino"], pair["score_02"]["oot"]
    scored = E.score(E.fit(kind, train, FEATURES, params=params), oot, threshold=0.5)
    lo, hi, n = scored.agg(F.min("y_pred_proba"), F.max("y_pred_proba"), F.count("*")).first()
    assert 0 <= lo <= hi <= 1 and n == oot.count()
    assert metrics.auc_gini(scored, "y_true", E.PROBABILITY).first().auc > 0.85
    again = E.score(E.fit(kind, train, FEATURES, params=params), oot)
    assert metrics.ks(again, "y_true", E.PROBABILITY).first() == metrics.ks(scored, "y_true", E.PROBABILITY).first()


def test_registry():
    assert {E.family_of(a) for a in ("lr", "LOGISTIC", "logistica")} == {"logistic"}
    assert E.default_name("hgb", 3) == "Hist Gradient Boosting - Etapa 3"
    with pytest.raises(ValueError):
        E.family_of("svm")
    with pytest.raises(ValueError):
        E.fit("lr", None, [])


def test_class_weights_balance(data):
    m = E.model_matrix(data, ["good"], "FPD")
    c = E.matrix_counts(m, ["good"])
    assert c["n"] == 3000 and c["present"]["good"] == 2700
    w = E.class_weights(m, c["n"], c["bad"]).groupBy(E.LABEL).agg(F.sum(E.WEIGHT).alias("s")).collect()
    assert len(w) == 2 and all(abs(x.s - 1500) < 1e-6 for x in w)
    with pytest.raises(ValueError, match="class"):
        E.class_weights(m, 10, 0)


def test_logistic_minimises_the_penalised_sum_of_losses(pair):
    """Gradient of C * sum(w * loss) + |b|^2 / 2 vanishes at the fitted coefficients."""
    train = pair["score_02"]["treino"]
    model = E.fit("lr", train, ["good", "noise"], params={"C": 0.5, "tol": 1e-12})
    lr = model.stages[-1]
    m = E.model_matrix(train, ["good", "noise"], "FPD")
    c = E.matrix_counts(m, ["good", "noise"])
    rows = model.transform(E.class_weights(m, c["n"], c["bad"])).select(E.VECTOR, E.LABEL, E.WEIGHT).collect()
    x = np.array([r[0].toArray() for r in rows])
    y, w = (np.array([r[i] for r in rows]) for i in (1, 2))
    p = 1 / (1 + np.exp(-(x @ lr.coefficients.toArray() + lr.intercept)))
    gradient = 0.5 * x.T @ (w * (p - y)) + lr.coefficients.toArray()
    assert np.abs(gradient).max() < 1e-2 and abs((w * (p - y)).sum()) < 1e-2


def test_logistic_starts_where_its_passes_end(pair):
    """Features that depend on each other: from zero the passes go on for long, from the Newton start they end at once."""
    train = pair["score_02"]["treino"].withColumn("twin", F.col("good") + 1e-3 * F.col("noise")).withColumn("far", F.col("good") * F.col("noise"))
    names = ["good", "noise", "twin", "far"]
    params = {"tol": 1e-9}
    started = E.fit("lr", train, names, params=params).stages[-1]
    m = E.model_matrix(train, names, "FPD")
    c = E.matrix_counts(m, names)
    plain = E.create("lr", names, weight_total=float(c["n"]), **params).fit(E.class_weights(m, c["n"], c["bad"])).stages[-1]
    assert started.summary.totalIterations <= 5 < plain.summary.totalIterations
    assert started.summary.objectiveHistory[-1] <= plain.summary.objectiveHistory[-1] + 1e-12
    assert np.allclose(started.coefficients.toArray(), plain.coefficients.toArray(), atol=0.05)


def test_a_feature_without_values_is_left_out(pair):
    train = pair["score_02"]["treino"].withColumn("empty", F.lit(None).cast("double"))
    assert E.features_of(E.fit("lr", train, ["good", "empty"])) == ["good"]
    with pytest.raises(ValueError, match="no feature"):
        E.fit("lr", train, ["empty"])


def test_columns_of_training_are_required(pair):
    model = E.fit("lr", pair["score_02"]["treino"], FEATURES)
    with pytest.raises(ValueError, match="noise"):
        E.score(model, pair["score_01"]["oot"])


def test_incremental_training(spark, pair, tmp_path):
    run = T.IncrementalTraining(pair, steps=[2, 1])
    out = run.run("lr", importance="permutation", n_repeats=2)
    rows = T.summary_table(out).collect()
    assert [r.Etapa for r in rows] == [1, 2] and [r.Features for r in rows] == [1, 3]
    assert rows[0].Delta_KS == rows[0].KS and rows[1].Delta_KS == rows[1].KS - rows[0].KS
    gb = run.run("gb", {"n_estimators": 3})
    side = metrics.compare_models(out, gb).collect()
    assert len(side) == 2 and all(r.diferenca_ks == r.ks_gb - r.ks_lr for r in side)
    table = metrics.confusion_table(out).collect()
    assert sum(table[0][3:7]) == pair["score_01"]["oot"].count()
    top = next(iter(run.importances.values()))
    assert top.first().feature == "good"
    key = writers.write_final_model(run.models, str(tmp_path / "m"), 2)
    assert key == "etapa_2_gradient_boosting_-_etapa_2"
    assert E.features_of(writers.read_model(str(tmp_path / "m"))) == FEATURES
    assert writers.write_final_model({}, str(tmp_path / "x"), 2) is None
    with pytest.raises(ValueError, match="FPD"):
        T.IncrementalTraining({"score_01": {k: v.drop("FPD") for k, v in pair["score_01"].items()}}, steps=[1]).run()
    with pytest.raises(KeyError):
        T.IncrementalTraining(pair, steps=[3]).run()


def test_permutation_importance_ranks_the_signal_first(pair):
    model = E.fit("lr", pair["score_02"]["treino"], FEATURES)
    out = I.permutation_importance(model, pair["score_02"]["oot"], "ID_UNICO", n_repeats=3).orderBy("ranking").collect()
    assert out[0].feature == "good" and out[0].importance_mean > 0.2 and abs(out[2].importance_mean) < 0.05
    f1 = I.permutation_importance(model, pair["score_02"]["oot"], "ID_UNICO", scoring="f1", n_repeats=2, max_samples=None).collect()
    assert len(f1) == 3
    with pytest.raises(ValueError):
        I.permutation_importance(model, pair["score_02"]["oot"], "ID_UNICO", scoring="zz")


def test_custom_scoring_is_pluggable(pair):
    model = E.fit("lr", pair["score_02"]["treino"], FEATURES)

    def mean_gap(scored, by):
        y, p = F.col("y_true"), F.col(E.PROBABILITY)
        return scored.groupBy(*by).agg((F.avg(F.when(y == 1, p)) - F.avg(F.when(y == 0, p))).alias("value"))

    out = I.permutation_importance(model, pair["score_02"]["oot"], "ID_UNICO", scoring=mean_gap, n_repeats=2)
    assert out.first().feature == "good"


def test_native_and_coefficient_importance(spark, pair):
    train = pair["score_02"]["treino"]
    trees = I.native_importance(E.fit("xgb", train, FEATURES, params={"n_estimators": 3}), spark)
    assert trees.count() == 3 and trees.orderBy("ranking").first().feature == "good"
    coef = I.coefficient_importance(E.fit("lr", train, FEATURES), spark).orderBy("ranking").collect()
    assert coef[0].feature == "good" and coef[0].importance == abs(coef[0].coeficiente)


def test_stress_and_grid(pair):
    train, oot = pair["score_02"]["treino"], pair["score_02"]["oot"]
    out = T.stress_test(train, oot, FEATURES, cuts=[1, 2, 50], params={"n_estimators": 2}).orderBy("qtd_variaveis").collect()
    assert [r.qtd_variaveis for r in out] == [1, 2]
    table, best = T.grid_search(train, FEATURES, grid={"max_depth": [2], "n_estimators": [2, 3]}, folds=2)
    rows = table.collect()
    assert len(rows) == 2 and rows[0].auc >= rows[1].auc > 0.8 and E.features_of(best) == FEATURES
    assert K.GRID["max_depth"] == [3, 5, 7]


def test_model_queries_run_the_whole_job(spark, data, monkeypatch):
    from __spark_entry__ import SMOKE_FOLDER, queries
    from riskmart.catalogue import Tables, modelling
    run, seen, fit = queries(), {}, E.fit
    base = modelling._base_tables(Tables(spark, SMOKE_FOLDER))

    def noted(name, result):
        return lambda *a, **k: seen.update({name: (a, k)}) or result

    monkeypatch.setattr(modelling, "_base_tables", lambda t: base)
    monkeypatch.setattr(E, "fit", lambda kind, train, names, *a, **k: seen.update(kind=kind, names=names) or fit("gb", train, names, params={"n_estimators": 1}))
    steps = run["model_incremental"](spark, SMOKE_FOLDER).collect()
    assert [r.Etapa for r in steps] == list(K.STEPS) and len({r.Features for r in steps}) == len(K.STEPS) and seen["kind"] == "logistic"
    monkeypatch.setattr(modelling.T, "grid_search", noted("grid", (data, None)))
    monkeypatch.setattr(modelling.T, "stress_test", noted("stress", data))
    run["model_grid"](spark, SMOKE_FOLDER)
    run["model_stress_topn"](spark, SMOKE_FOLDER)
    assert seen["grid"][1] == {} and len(seen["grid"][0]) == 2 and seen["kind"] == "xgboost"
    assert seen["stress"][1] == {} and len(seen["stress"][0]) == 3 and len(set(seen["stress"][0][2])) >= max(K.STRESS_CUTS)


def test_cuts_beyond_the_features_are_reported(pair):
    train, oot = pair["score_02"]["treino"], pair["score_02"]["oot"]
    with pytest.warns(UserWarning, match=r"\[50, 90\]: only 3 features"):
        assert T.stress_test(train, oot, FEATURES, cuts=[1, 50, 90], params={"n_estimators": 1}).count() == 1


def test_capped_sample_equals_a_sort(spark, monkeypatch):
    monkeypatch.setattr(splits, "_LEFT", 2)
    monkeypatch.setattr(splits, "_DIGITS", 1)
    df = spark.range(400).select(F.when(F.col("id") >= 5, F.concat(F.lit("k"), "id")).alias("key"), "id").repartition(6)
    rows = df.orderBy(splits._hash("key", 42), "key").collect()
    for size in (0, 3, 6, 37, 400, 900):
        got = splits.sample_capped(df, "key", size)
        assert got.columns == df.columns and got.count() == min(size, 400)
        if size >= 5:  # rows without a key tie
            assert {r.id for r in got.collect()} == {r.id for r in rows[:size]}
    assert splits.sample_capped(df.limit(0), "key", 3).count() == 0
