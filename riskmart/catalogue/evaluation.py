"""Model-evaluation reports on scored line items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.catalogue import query
from riskmart.catalogue.roles import (SCORED_ORDERS_SQL, SCORED_SQL, scored, scored_orders)
from riskmart.operators import metrics


def _curve(src: str, p: str, by: str = "", flag: bool = False) -> str:
    """Running good and bad counts per distinct score, riskiest first."""
    part = f"PARTITION BY {by}" if by else ""
    key = f"{by}, " if by else ""
    extra = ", sum(CASE WHEN flag = 1 THEN y_true ELSE 0 END) AS kb, sum(CASE WHEN flag = 1 THEN 1 - y_true ELSE 0 END) AS kg" if flag else ""
    wextra = (f", sum(kb) OVER ({part} ORDER BY p DESC) AS ckb, sum(kg) OVER ({part} ORDER BY p DESC) AS ckg, "
              f"sum(kb) OVER ({part}) AS tkb, sum(kg) OVER ({part}) AS tkg") if flag else ""
    return f"""SELECT *, sum(bad) OVER ({part} ORDER BY p DESC) AS cb, sum(good) OVER ({part} ORDER BY p DESC) AS cg,
  sum(bad) OVER ({part}) AS tb, sum(good) OVER ({part}) AS tg {wextra}
FROM (SELECT {key}{p} AS p, sum(y_true) AS bad, sum(1 - y_true) AS good {extra} FROM ({src}) GROUP BY {key}{p})"""


_GAP = "abs(CAST(cb AS DOUBLE) / CAST(tb AS DOUBLE) - CAST(cg AS DOUBLE) / CAST(tg AS DOUBLE))"
_AUC = "CAST(sum(good * (cb * 2 - bad)) AS DOUBLE) / (2.0::DOUBLE * max(tb) * max(tg))"


def _ks(src: str, p: str) -> str:
    return f"""SELECT gap * 100 AS ks, p AS ks_threshold FROM (SELECT *, {_GAP} AS gap FROM ({_curve(src, p)}))
ORDER BY gap DESC, p DESC LIMIT 1"""


@query("met_ks", f"SELECT ks FROM ({_ks(SCORED_SQL, 'p2')})")
def _(t):
    return metrics.ks(scored(t), "y_true", "p2").select("ks")


@query("met_threshold", _ks(SCORED_SQL, "p"))
def _(t):
    return metrics.ks(scored(t), "y_true", "p")


@query("met_auc_gini", f"SELECT auc, (2.0::DOUBLE * auc - 1) * 100 AS gini FROM (SELECT {_AUC} AS auc FROM ({_curve(SCORED_SQL, 'p2')}))")
def _(t):
    return metrics.auc_gini(scored(t), "y_true", "p2")


@query("met_auc_ties", f"""
WITH g AS (SELECT p, count(*) AS n FROM ({SCORED_SQL}) WHERE y_true = 0 GROUP BY p),
b AS (SELECT p, count(*) AS n FROM ({SCORED_SQL}) WHERE y_true = 1 GROUP BY p),
c AS (SELECT sum(CASE WHEN b.p > g.p THEN 2 * b.n * g.n WHEN b.p = g.p THEN b.n * g.n ELSE 0 END) AS twice FROM b, g)
SELECT twice / (2.0::DOUBLE * (SELECT sum(n) FROM b) * (SELECT sum(n) FROM g)) AS auc FROM c""")
def _(t):
    return metrics.auc_gini(scored(t), "y_true", "p").select("auc")


def _cm(src: str, p: str, threshold: float) -> str:
    return f"""SELECT count(*) FILTER (y_true = 0 AND {p} < {threshold}) AS tn, count(*) FILTER (y_true = 0 AND {p} >= {threshold}) AS fp,
  count(*) FILTER (y_true = 1 AND {p} < {threshold}) AS fn, count(*) FILTER (y_true = 1 AND {p} >= {threshold}) AS tp FROM ({src})"""


_RATES = """CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS specificity"""
_F1 = "CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall) ELSE 0 END AS f1_score"


@query("met_confusion", _cm(SCORED_SQL, "p", 0.05))
def _(t):
    return metrics.confusion(scored(t), "y_true", "p", 0.05)


@query("met_confusion_metrics", f"SELECT *, {_F1} FROM (SELECT *, {_RATES} FROM ({_cm(SCORED_SQL, 'p', 0.05)}))")
def _(t):
    return metrics.rates_of_confusion(metrics.confusion(scored(t), "y_true", "p", 0.05))


def _swap(ig, ib, og, ob, ki, ko) -> str:
    pct = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) * 100 ELSE 0.0::DOUBLE END"
    ins, outs = f"({ig} + {ib})", f"({og} + {ob})"
    cells = {"swap_in_total": ins, "swap_in_good": ig, "swap_in_bad": ib, "swap_in_hit_pct": pct(ig, ins), "swap_out_total": outs,
             "swap_out_good": og, "swap_out_bad": ob, "swap_out_hit_pct": pct(ob, outs), "kept_approved": ki, "kept_rejected": ko,
             "n_rows": f"{ins} + {outs} + {ki} + {ko}", "policy_approved": f"{outs} + {ki}", "policy_rejected": f"{ins} + {ko}",
             "model_approved": f"{ins} + {ki}", "model_rejected": f"{outs} + {ko}"}
    return ", ".join(f"{e if n.endswith('pct') else f'CAST({e} AS BIGINT)'} AS {n}" for n, e in cells.items())


def _q(f: int, m: int, y: int | None) -> str:
    return f"count(*) FILTER (flag = {f} AND pred = {m}{'' if y is None else f' AND y_true = {y}'})"


@query("met_swap", f"""
SELECT {_swap('ig', 'ib', 'og', 'ob', 'ki', 'ko')} FROM (SELECT {_q(0, 0, 0)} AS ig, {_q(0, 0, 1)} AS ib, {_q(1, 1, 0)} AS og,
  {_q(1, 1, 1)} AS ob, {_q(1, 0, None)} AS ki, {_q(0, 1, None)} AS ko FROM (SELECT *, CAST(p >= 0.05 AS INTEGER) AS pred FROM ({SCORED_SQL})))""")
def _(t):
    df = scored(t).withColumn("pred", (F.col("p") >= 0.05).cast("int"))
    return metrics.swap(df, "y_true", "pred", "flag")


@query("met_validate", f"""
SELECT count(*) AS n_rows, count(*) FILTER (y IS NULL) AS y_null, count(*) FILTER (y NOT IN (0, 1)) AS y_not_binary,
  count(*) FILTER (s IS NULL) AS p_null, count(*) FILTER (flag IS NULL) AS flag_null, count(*) FILTER (flag NOT IN (0, 1)) AS flag_not_binary
FROM (SELECT CASE WHEN p = 0.03 THEN NULL WHEN p = 0.04 THEN 2 ELSE y_true END AS y, CASE WHEN p > 0.08 THEN NULL ELSE p END AS s, flag FROM ({SCORED_SQL}))""")
def _(t):
    df = scored(t).select(
        F.when(F.col("p") == 0.03, F.lit(None)).when(F.col("p") == 0.04, 2).otherwise(F.col("y_true")).alias("y"),
        F.when(F.col("p") <= 0.08, F.col("p")).alias("s"), "flag")
    return metrics.violations(df, "y", "s", "flag")


def _full(src: str, p: str, bench: float = K.BENCHMARK_KS) -> str:
    return f"""
WITH c AS (SELECT *, {_GAP} AS gap FROM ({_curve(src, p, flag=True)})),
best AS (SELECT * FROM c ORDER BY gap DESC, p DESC LIMIT 1), a AS (SELECT {_AUC} AS auc FROM c),
m AS (SELECT gap * 100 AS ks, gap * 100 - {bench}::DOUBLE AS ks_vs_benchmark, p AS ks_threshold, p AS threshold, (2.0::DOUBLE * auc - 1) * 100 AS gini, auc,
  CAST(tg - cg AS BIGINT) AS tn, CAST(cg AS BIGINT) AS fp, CAST(tb - cb AS BIGINT) AS fn, CAST(cb AS BIGINT) AS tp,
  CAST(tg - tkg - (cg - ckg) AS BIGINT) AS ig, CAST(tb - tkb - (cb - ckb) AS BIGINT) AS ib, CAST(ckg AS BIGINT) AS og, CAST(ckb AS BIGINT) AS ob,
  CAST(tkb + tkg - ckb - ckg AS BIGINT) AS ki, CAST(cb - ckb + cg - ckg AS BIGINT) AS ko FROM best, a)
SELECT * EXCLUDE (ig, ib, og, ob, ki, ko), {_F1}, {_swap('ig', 'ib', 'og', 'ob', 'ki', 'ko')} FROM (SELECT *, {_RATES} FROM m)"""


@query("met_full", _full(SCORED_SQL, "p2"))
def _(t):
    return metrics.evaluate(scored(t), "y_true", "p2", flag="flag")


def _measures(src: str, p: str, threshold: float) -> str:
    """KS, Gini, AUC and the confusion rates at a fixed threshold."""
    return f"""SELECT k.ks, (2.0::DOUBLE * auc - 1) * 100 AS gini, auc, r.* FROM ({_ks(src, p)}) k,
  (SELECT {_AUC} AS auc FROM ({_curve(src, p)})) a, (SELECT *, {_F1} FROM (SELECT *, {_RATES} FROM ({_cm(src, p, threshold)}))) r"""


@query("met_fixed_threshold", _measures(SCORED_SQL, "p2", 0.5))
def _(t):
    return metrics.evaluate(scored(t), "y_true", "p2", threshold=0.5, use_ks_threshold=False).drop(
        "ks_vs_benchmark", "ks_threshold", "threshold")


def _step_sql(i: int, name: str, p: str) -> str:
    return (f"SELECT '{name}' AS modelo, {i} AS etapa, ks, gini, auc, tn, fp, fn, tp FROM ({_measures(SCORED_SQL, p, 0.05)})")


def _steps(t):
    parts = {}
    for name, scores in {"lr": ["p", "p2"], "gb": ["p2", "p"]}.items():
        rows = [metrics.evaluate(scored(t), "y_true", s, threshold=0.05, use_ks_threshold=False).select(
            F.lit(i).alias("etapa"), "ks", "gini", "auc", "tn", "fp", "fn", "tp") for i, s in enumerate(scores, 1)]
        parts[name] = rows[0].unionByName(rows[1])
    return parts


_STEPS_SQL = " UNION ALL ".join([_step_sql(1, "lr", "p"), _step_sql(2, "lr", "p2"), _step_sql(1, "gb", "p2"), _step_sql(2, "gb", "p")])


@query("met_summary_long", f"""
SELECT *, coalesce(lag(ks) OVER w, 0.0) AS ks_anterior, ks - coalesce(lag(ks) OVER w, 0.0) AS delta_ks FROM ({_STEPS_SQL})
WINDOW w AS (PARTITION BY modelo ORDER BY etapa)""")
def _(t):
    return metrics.with_delta(metrics.stack_records(_steps(t)))


@query("met_confusion_table", f"""
SELECT modelo, etapa, 'Etapa' AS nome_etapa, tn AS tn_real0_pred0, fp AS fp_real0_pred1, fn AS fn_real1_pred0, tp AS tp_real1_pred1
FROM ({_STEPS_SQL})""")
def _(t):
    return metrics.confusion_table(metrics.stack_records(_steps(t)).withColumn("nome_etapa", F.lit("Etapa")))


@query("met_compare", f"""
WITH s AS ({_STEPS_SQL})
SELECT a.etapa, a.ks AS ks_lr, b.ks AS ks_gb, b.ks - a.ks AS diferenca_ks FROM s a JOIN s b ON a.etapa = b.etapa AND a.modelo = 'lr' AND b.modelo = 'gb'""")
def _(t):
    s = _steps(t)
    return metrics.compare_models(s["lr"], s["gb"])


@query("met_model_table", " UNION ALL ".join(
    f"SELECT '{n}' AS modelo, ks, gini, auc, accuracy, precision, recall, f1_score FROM ({_measures(SCORED_SQL, p, 0.05)})"
    for n, p in {"LR": "p", "GB": "p2"}.items()))
def _(t):
    return metrics.model_table({n: metrics.evaluate(scored(t), "y_true", p, threshold=0.05, use_ks_threshold=False)
                                for n, p in {"LR": "p", "GB": "p2"}.items()})


_ROC = f"""SELECT {{key}} p AS threshold, CAST(cg AS DOUBLE) / CAST(tg AS DOUBLE) AS fpr, CAST(cb AS DOUBLE) / CAST(tb AS DOUBLE) AS tpr"""


@query("met_roc_points", f"""
{_ROC.format(key='population,')} FROM ({_curve(f"SELECT *, CASE WHEN vintage >= 200001 THEN 'Teste' ELSE 'Treino' END AS population FROM ({SCORED_SQL})", 'p2', 'population')})""")
def _(t):
    df = scored(t).withColumn("population", F.when(F.col("vintage") >= 200001, "Teste").otherwise("Treino"))
    return metrics.roc_points(df, "y_true", "p2", by=["population"])


@query("met_ks_curve", f"""
SELECT p, CAST(cb + cg AS DOUBLE) / CAST(tb + tg AS DOUBLE) * 100 AS population_pct, CAST(cb AS DOUBLE) / CAST(tb AS DOUBLE) * 100 AS cum_bad_pct,
  CAST(cg AS DOUBLE) / CAST(tg AS DOUBLE) * 100 AS cum_good_pct, {_GAP} * 100 AS ks_distance FROM ({_curve(SCORED_SQL, 'p')})""")
def _(t):
    return metrics.ks_curve(scored(t), "y_true", "p")


@query("met_direction_auc", f"""
SELECT 'p' AS score, greatest(auc, 1 - auc) AS auc, auc < 0.5 AS reversed FROM (SELECT {_AUC} AS auc FROM ({_curve(SCORED_SQL, 'p')}))
UNION ALL SELECT 'neg', greatest(auc, 1 - auc), auc < 0.5 FROM (SELECT {_AUC} AS auc FROM ({_curve(SCORED_SQL, '-p')}))""")
def _(t):
    return metrics.direction_free_auc(scored(t).withColumn("neg", -F.col("p")), "y_true", ["p", "neg"])


@query("met_by_vintage", f"""
WITH c AS (SELECT *, {_GAP} AS gap FROM ({_curve(SCORED_SQL, 'p2', 'vintage')}))
SELECT c.vintage, CAST(max(tb) + max(tg) AS BIGINT) AS volume, CAST(max(tb) AS BIGINT) / CAST(max(tb) + max(tg) AS BIGINT) * 100 AS bad_rate_pct,
  max(gap) * 100 AS ks, (2.0::DOUBLE * ({_AUC}) - 1) * 100 AS gini, any_value(base) AS base
FROM c JOIN (SELECT vintage, CASE WHEN avg(flag) > 0.5 THEN 'OOT (Teste)' ELSE 'Treino' END AS base FROM ({SCORED_SQL}) GROUP BY vintage) f
  ON f.vintage = c.vintage GROUP BY c.vintage HAVING max(tb) > 0 AND max(tg) > 0""")
def _(t):
    return metrics.by_vintage(scored(t), "y_true", "p2", "vintage", oot_flag="flag")


_RANKED = f"SELECT *, row_number() OVER (ORDER BY p DESC, id) AS pos, count(*) OVER () AS n FROM ({SCORED_ORDERS_SQL})"


def _simulated(f: float, baseline: float) -> str:
    return f"""SELECT {f}::DOUBLE AS rejected_share, count(*) FILTER (pos <= floor(n * {f}::DOUBLE)) AS n_rejected,
  count(*) FILTER (pos > floor(n * {f}::DOUBLE)) AS n_approved, avg(y_true) FILTER (pos > floor(n * {f}::DOUBLE)) * 100 AS approved_rate_pct,
  avg(y_true) FILTER (pos <= floor(n * {f}::DOUBLE)) * 100 AS rejected_rate_pct,
  {baseline}::DOUBLE - avg(y_true) FILTER (pos > floor(n * {f}::DOUBLE)) * 100 AS reduction_points FROM ranked"""


@query("met_simulation", f"WITH ranked AS ({_RANKED}) {_simulated(0.25, 16.0)} UNION ALL {_simulated(0.22, 16.0)}")
def _(t):
    return metrics.simulate_cutoff(scored_orders(t), "y_true", "p", "id", [0.25, 0.22], 16.0)


@query("cut_worst_fraction", f"SELECT id, CAST(pos <= floor(n * 0.25::DOUBLE) AS INTEGER) AS rejected, pos AS position FROM ({_RANKED})")
def _(t):
    return metrics.reject_worst(scored_orders(t), "p", "id", 0.25).select("id", "rejected", "position")
