"""The training run as one job: step tables in; evaluated models, reports and the final model out.

    spark-submit --py-files riskmart.zip riskmart/plans/training_job.py --tables <root> --out <root> [--sample 0.2] [--top 80]

Every step gets its own model on its own table. The features of the last step are then ranked by importance, those that
follow a better one too closely leave, the best of the rest make the final model, which is scored on the training, the
later and the control population.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.models import estimators as E
from riskmart.models import training as T
from riskmart.operators import metrics, ranking, splits, stats
from riskmart.session import get_spark, stored
from riskmart.sources import readers, writers
from riskmart.sources.naming import find_table, step_table


@dataclass(frozen=True)
class TrainingJob:
    """What to train; `sample` is the share of the training rows, `top` the number of features of the final model."""

    tables: str
    out: str
    kind: str = "xgboost"
    params: Mapping | None = None
    sample: float = 1.0
    oot: Sequence[int] = tuple(K.OOT_VINTAGES)
    steps: Sequence[int] = tuple(K.STEPS)
    importance: str = "native"
    top: int = 80
    collinear: float | None = K.COLLINEAR_LIMIT


def ranked_with_share(importance: DataFrame) -> DataFrame:
    """ranking, feature, importance and its running share, for either kind of importance table."""
    value = "importance" if "importance" in importance.columns else "importance_mean"
    table = importance.select("ranking", "feature", F.col(value).alias("importance"))
    share = ranking.cumulative_share(table, "importance", "feature", "__sum")
    total = table.agg(F.sum("importance")).first()[0]
    return share.withColumn("acumulado", F.col("__sum") / F.lit(total) if total else F.lit(None).cast("double")).drop("__sum")


def final_features(importance: DataFrame, train: DataFrame, top: int, collinear: float | None = K.COLLINEAR_LIMIT, key: str = K.ID,
                   target: str = K.TARGET) -> list[str]:
    """The best features in order, without those whose rank correlation with a better one is above the limit."""
    names = [r.feature for r in ranked_with_share(importance).where("importance > 0").orderBy("ranking").select("feature").collect()]
    if collinear is not None and len(names) > 1:
        matrix = stored(E.model_matrix(train, names, target, keep=[key]), "final-features")
        close = stats.collinear_columns(stats.spearman_pairs(matrix, names, key, collinear), collinear)
        gone = {r[0] for r in close.collect()}
        names = [n for n in names if n not in gone]
    return names[:top]


def run(spark: SparkSession, job: TrainingJob) -> dict[str, DataFrame]:
    """Run the job: reports below ``out/relatorios`` as CSV, the model in ``out/modelo_final``; returns the reports."""
    tables = readers.read_all(spark, job.tables)
    wanted = {n: tables[n] for n in dict.fromkeys(find_table(tables, step_table(s)) for s in job.steps)}
    pairs, counts, control = splits.prepare(wanted, job.oot)
    pairs = splits.sample_train(pairs, job.sample)
    training = T.IncrementalTraining(pairs, tuple(job.steps))
    results = training.run(job.kind, dict(job.params or {}), importance=job.importance)

    last = max(job.steps)
    name, train, oot = T.step_splits(last, pairs)
    tag = next(t for t in training.importances if t.startswith(f"etapa_{last}_"))
    features = final_features(training.importances[tag], train, job.top, job.collinear)
    if not features:
        raise ValueError("no feature of the last step has any importance")
    model = E.fit(job.kind, train, features, params=dict(job.params or {}))
    populations = {"Treino": train, "Teste": oot, **{"Controle": df for n, df in control.items() if n == f"{name}_gc"}}
    scored = stored(T.score_splits(model, populations, keep=[K.VINTAGE]), "final-scored")
    measures = metrics.auc_gini(scored, "y_true", E.PROBABILITY, by=["population"]).join(
        metrics.ks(scored, "y_true", E.PROBABILITY, by=["population"]), "population").join(
        scored.groupBy("population").agg(F.count("*").alias("n_rows"), F.avg("y_true").alias("bad_rate")), "population")
    reports = {
        "resultados": results, "resumo": T.summary_table(results), "matriz_confusao": metrics.confusion_table(results), "contagens": counts,
        **{f"importancia_{t}": ranked_with_share(df) for t, df in training.importances.items()},
        "variaveis_finais": spark.createDataFrame([(i, f) for i, f in enumerate(features, 1)], "ranking int, feature string"),
        "populacoes": measures, "estabilidade": metrics.by_vintage(scored.where("population <> 'Controle'"), "y_true", E.PROBABILITY, K.VINTAGE),
    }
    root = job.out.rstrip("/")
    writers.write_reports(reports, f"{root}/relatorios")
    writers.write_final_model({tag: model}, f"{root}/modelo_final", last)
    return reports


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--tables", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--kind", default="xgboost")
    parser.add_argument("--sample", type=float, default=1.0)
    parser.add_argument("--top", type=int, default=80)
    parser.add_argument("--settings", help="JSON file of session settings")
    given = parser.parse_args(argv)
    spark = get_spark("riskmart-training", path=given.settings)
    run(spark, TrainingJob(given.tables, given.out, given.kind, sample=given.sample, top=given.top))


if __name__ == "__main__":
    main()
