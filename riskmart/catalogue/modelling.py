"""Samples, model steps and importances. Results are checked by properties, not by SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.catalogue import query
from riskmart.catalogue.base_table import _registration
from riskmart.catalogue.roles import OOT, ORDER_DOMAINS, PAYMENT_DOMAINS, VINTAGES, customer_payments, order_recharges, raw_score, raw_telco
from riskmart.models import estimators as E
from riskmart.models import importance as I
from riskmart.models import training as T
from riskmart.operators import metrics, splits
from riskmart.plans import abt, books, silver
from riskmart.session import cut_lineage, shared_folder, stored

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"]


def line_table(t) -> DataFrame:
    """Line items with part attributes; target: a net amount that is high for the part size."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id"),
        (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("SAFRA"),
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice",
        F.col("l_linestatus").eqNullSafe("O").cast("int").alias(K.INSTALLED),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 25000 + 300 * F.col("p_size")).cast("int").alias(K.TARGET))
    return rows


LINES_SQL = f"""
SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS SAFRA,
  CASE WHEN l_linenumber <> 7 THEN l_quantity END AS l_quantity, l_extendedprice, l_discount, l_tax, p_size, p_retailprice,
  CAST(coalesce(l_linestatus = 'O', false) AS INTEGER) AS {K.INSTALLED},
  CAST(l_extendedprice * (1 - l_discount) > 25000 + 300 * p_size AS INTEGER) AS {K.TARGET}
FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _chosen(fraction: float) -> str:
    return f"substr(md5('{K.SEED}:' || id), 1, 8) < '{round(fraction * 16 ** 8):08x}'"


def _pair(t) -> tuple[DataFrame, DataFrame]:
    """Training and later-vintage rows, stored once because every fit reads them many times."""
    df = stored(line_table(t), "model-lines")
    pair = splits.split_train_oot({"x": df}, [v for y in (2001,) for v in range(y * 100 + 1, y * 100 + 13)])["x"]
    return pair[splits.TRAIN], pair[splits.OOT]


def _evaluated(model, oot, flag: bool = False) -> DataFrame:
    scored = cut_lineage(E.score(model, oot, keep=[K.INSTALLED]))
    return metrics.evaluate(scored, "y_true", E.PROBABILITY, flag=K.INSTALLED if flag else None)


# --- samples -----------------------------------------------------------------

@query("sample_train", f"""
SELECT *, CASE WHEN SAFRA // 100 = 2001 THEN 'oot' ELSE 'treino' END AS split FROM ({LINES_SQL}) WHERE SAFRA // 100 = 2001 OR {_chosen(0.2)}""")
def _(t):
    train, oot = _pair(t)
    s = splits.sample_train({"x": {splits.TRAIN: train, splits.OOT: oot}}, 0.2, "id")["x"]
    return s[splits.TRAIN].withColumn("split", F.lit("treino")).unionByName(s[splits.OOT].withColumn("split", F.lit("oot")))


@query("sample_stratified", f"""
SELECT * FROM ({LINES_SQL}) WHERE {K.TARGET} = 0 AND {_chosen(0.25)} OR {K.TARGET} = 1 AND {_chosen(0.5)}""")
def _(t):
    return splits.sample_stratified(line_table(t), K.TARGET, {0: 0.25, 1: 0.5}, "id")


@query("sample_hashed", f"SELECT * FROM orders WHERE substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 8) < '{round(0.35 * 16 ** 8):08x}'")
def _(t):
    return splits.sample_hashed(t.orders, "o_orderkey", 0.35)


@query("sample_capped", "SELECT * FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 5000")
def _(t):
    return splits.sample_capped(t.orders, "o_orderkey", 5000)


# --- models ------------------------------------------------------------------

@query("model_logistic")
def _(t):
    train, oot = _pair(t)
    return _evaluated(E.fit("lr", train, FEATURES), oot, flag=True)


@query("model_gbt")
def _(t):
    train, oot = _pair(t)
    return _evaluated(E.fit("gb", train, FEATURES), oot)


@query("model_hist_gbt")
def _(t):
    train, oot = _pair(t)
    return _evaluated(E.fit("hgb", train, FEATURES), oot)


@query("model_xgb_alias")
def _(t):
    train, oot = _pair(t)
    return _evaluated(E.fit("xgb", train, FEATURES), oot)


@query("model_predict")
def _(t):
    train, oot = _pair(t)
    return E.score(E.fit("lr", train, FEATURES), oot, keep=["id"], threshold=0.5)


def _base_tables(t) -> dict[str, DataFrame]:
    """The six modelling tables, stored: every fit reads them many times."""
    registration, until = _registration(t), max(VINTAGES.values())
    tables = abt.build_stored(
        {"score_bureau_full": silver.score(raw_score(t)), "telco": silver.telco(raw_telco(t)), "cadastral": registration},
        books.recharge_book(registration, order_recharges(t), ORDER_DOMAINS, until=until),
        books.payment_book(registration, customer_payments(t), PAYMENT_DOMAINS, until=until),
        f"{shared_folder(t.spark).rstrip('/')}/model-base-{uuid.uuid4().hex}", oot=OOT)
    return {name: tables[name] for _, name in K.STEPS.values()}


@query("model_incremental")
def _(t):
    pairs, _, _ = splits.prepare(_base_tables(t), OOT)
    return T.summary_table(T.IncrementalTraining(pairs).run("logistic"))


@query("model_stress_topn")
def _(t):
    pairs, _, _ = splits.prepare(_base_tables(t), OOT)
    last = max(K.STEPS)
    _, train, oot = T.step_splits(last, pairs)
    names = T.IncrementalTraining(pairs).features(last)
    ranked = I.native_importance(E.fit("xgboost", train, names), t.spark).orderBy("ranking").select("feature").collect()
    names = [r.feature for r in ranked]
    return T.with_every_cut(T.stress_test(train, oot, names), names)


@query("model_grid")
def _(t):
    train, _ = _pair(t)
    table, _ = T.grid_search(train, FEATURES)
    return table


# --- importances -------------------------------------------------------------

@query("imp_permutation")
def _(t):
    train, oot = _pair(t)
    return I.permutation_importance(E.fit("lr", train, FEATURES), oot, "id")


@query("imp_native")
def _(t):
    train, _ = _pair(t)
    return I.native_importance(E.fit("gb", train, FEATURES), t.spark)


@query("imp_coef")
def _(t):
    train, _ = _pair(t)
    return I.coefficient_importance(E.fit("lr", train, FEATURES), t.spark)


@query("score_populations")
def _(t):
    train, oot = _pair(t)
    scored = T.score_splits(E.fit("lr", train, FEATURES), {"Treino": train, "Teste": oot})
    return metrics.auc_gini(scored, "y_true", E.PROBABILITY, by=["population"])
