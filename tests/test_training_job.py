import pytest
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.models import estimators as E
from riskmart.plans import training_job as J
from riskmart.sources import readers, writers


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Two step tables with a signal, a copy of it, noise, later vintages and a control group."""
    df = spark.range(2500).select(
        F.concat(F.lit("k"), "id").alias("ID_UNICO"), (F.col("id") % 10 == 0).cast("int").alias("GRUPO_CONTROLE"),
        F.when(F.col("id") % 4 == 0, K.OOT_VINTAGES[0]).otherwise(202401).alias("SAFRA"), F.rand(1).alias("good"), F.rand(2).alias("noise"))
    df = df.withColumns({"copy": F.col("good") * 3 + 0.001 * F.rand(5), "FPD": (F.col("good") * 0.8 + F.rand(4) * 0.4 > 0.6).cast("int")})
    out = tmp_path_factory.mktemp("tables")
    writers.write_parquet(df.drop("copy", "noise"), str(out / "score_01"))
    writers.write_parquet(df, str(out / "score_02"))
    return out


def test_job_from_tables_to_reports_and_model(spark, root, tmp_path):
    job = J.TrainingJob(str(root), str(tmp_path), params={"n_estimators": 5, "colsample": 1.0}, steps=(1, 2), top=2)
    reports = J.run(spark, job)
    assert [r.Etapa for r in readers.read_csv(spark, f"{tmp_path}/relatorios/resumo").collect()] in ([1, 2], ["1", "2"])
    final = [r.feature for r in reports["variaveis_finais"].orderBy("ranking").collect()]
    assert len(final) == 2 and "noise" in final and len({"good", "copy"} & set(final)) == 1  # the weaker of two near equals leaves
    model = writers.read_model(f"{tmp_path}/modelo_final")
    assert E.features_of(model) == final
    rows = {r.population: r for r in reports["populacoes"].collect()}
    assert set(rows) == {"Treino", "Teste", "Controle"} and sum(r.n_rows for r in rows.values()) == 2500 and rows["Controle"].n_rows == 250
    assert all(r.auc > 0.85 for r in rows.values())
    assert reports["estabilidade"].count() == 2 and reports["contagens"].agg(F.sum("n_rows")).first()[0] > 0


def test_job_without_its_tables_is_refused(spark, root, tmp_path):
    with pytest.raises(KeyError):
        J.run(spark, J.TrainingJob(str(root), str(tmp_path), steps=(1, 6)))


def test_share_of_importances(spark):
    table = spark.createDataFrame([(1, "a", 3.0), (2, "b", 1.0), (3, "c", 0.0)], "ranking int, feature string, importance double")
    assert [r.acumulado for r in J.ranked_with_share(table).orderBy("ranking").collect()] == [0.75, 1.0, 1.0]
    means = table.withColumnRenamed("importance", "importance_mean")
    assert J.final_features(means, spark.range(1), 5, None) == ["a", "b"]
    assert J.ranked_with_share(table.withColumn("importance", F.lit(0.0))).where("acumulado is null").count() == 3
