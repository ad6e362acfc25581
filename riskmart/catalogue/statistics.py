"""Correlation, proportion test and sampling simulation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.catalogue import query
from riskmart.catalogue.roles import SCORED_SQL, scored
from riskmart.operators import stats

_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("stat_corr_target", " UNION ALL ".join(
    f"SELECT '{c}' AS variavel, round(corr({c}, CAST(l_returnflag = 'R' AS INTEGER)), 8) AS corr FROM lineitem" for c in _COLUMNS))
def _(t):
    df = t.lineitem.select(*_COLUMNS, (F.col("l_returnflag") == "R").cast("int").alias("alvo"))
    return stats.correlation_with(df, "alvo", _COLUMNS).withColumn("corr", F.round("corr", 8))


#: 32 columns, every one with nulls in other rows.
_WIDE = {f"{c}_{k}": f"CASE WHEN (l_orderkey + l_linenumber * {k + 2}) % {k + 5} > 0 THEN {c} * (1 + (l_partkey % {k + 3}) * {k}) END" for c in _COLUMNS for k in range(8)}
_WIDE_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _WIDE.items()) + " FROM lineitem"


@query("stat_corr_matrix", f"WITH w AS ({_WIDE_SQL}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS variavel_1, '{b}' AS variavel_2, round(corr({a}, {b}), 8) AS corr FROM w" for a, b in combinations(_WIDE, 2)))
def _(t):
    return stats.correlation_pairs(t.lineitem.selectExpr(*[f"{e} AS {n}" for n, e in _WIDE.items()]), list(_WIDE)).withColumn("corr", F.round("corr", 8))


_PART = ["p_size", "p_retailprice", "p_half"]
_PART_SQL = "SELECT p_partkey, p_size, p_retailprice, p_size // 10 AS p_half FROM part"
_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in _PART)


@query("stat_spearman_pairs", f"WITH r AS (SELECT {_RANKS} FROM ({_PART_SQL})) " + " UNION ALL ".join(
    f"SELECT '{a}' AS variavel_1, '{b}' AS variavel_2, round(abs(corr({a}, {b})), 8) AS rho FROM r" for a, b in combinations(_PART, 2)))
def _(t):
    df = t.part.select("p_partkey", "p_size", "p_retailprice", F.floor(F.col("p_size") / 10).alias("p_half"))
    return stats.spearman_pairs(df, _PART, "p_partkey").withColumn("rho", F.round("rho", 8))


@query("stat_collinear", f"WITH r AS (SELECT {_RANKS} FROM ({_PART_SQL})), p AS (" + " UNION ALL ".join(
    f"SELECT '{b}' AS variavel, abs(corr({a}, {b})) AS rho FROM r" for a, b in combinations(_PART, 2))
    + f") SELECT DISTINCT variavel FROM p WHERE rho > {K.COLLINEAR_LIMIT}")
def _(t):
    df = t.part.select("p_partkey", "p_size", "p_retailprice", F.floor(F.col("p_size") / 10).alias("p_half"))
    return stats.collinear_columns(stats.spearman_pairs(df, _PART, "p_partkey"), K.COLLINEAR_LIMIT)


@query("stat_ztest", f"""
WITH s AS (SELECT CAST(sum(y_true) FILTER (flag = 1) AS BIGINT) AS x1, count(*) FILTER (flag = 1) AS n1,
  CAST(sum(y_true) FILTER (flag = 0) AS BIGINT) AS x2, count(*) FILTER (flag = 0) AS n2 FROM ({SCORED_SQL}))
SELECT *, x1 / n1 AS p1, x2 / n2 AS p2, round((x1 / n1 - x2 / n2) / sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 9) AS z FROM s""")
def _(t):
    return stats.proportion_test(scored(t), "y_true", F.col("flag") == 1).drop("p_value", "verdict").withColumn("z", F.round("z", 9))


@query("stat_ztest_verdict", f"""
WITH s AS (SELECT sum(y_true) FILTER (flag = 1) AS x1, count(*) FILTER (flag = 1) AS n1,
  sum(y_true) FILTER (flag = 0) AS x2, count(*) FILTER (flag = 0) AS n2 FROM ({SCORED_SQL})),
z AS (SELECT (x1 / n1 - x2 / n2) / sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS z FROM s)
SELECT round(z, 9) AS z, CASE WHEN abs(z) > 1.959963984540054 THEN 'Significante (H0 Rejeitada)' ELSE 'Não Significante (Falha em rejeitar H0)' END AS verdict FROM z""")
def _(t):
    return stats.proportion_test(scored(t), "y_true", F.col("flag") == 1).select(F.round("z", 9).alias("z"), "verdict")


@query("stat_binomial_sim")
def _(t):
    sim = stats.binomial_simulation(scored(t), "y_true", F.col("flag") == 1)
    return stats.simulation_limit(sim)
