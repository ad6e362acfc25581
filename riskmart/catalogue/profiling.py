"""Profile reports, report windows, sorts and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmart.catalogue import query
from riskmart.catalogue.roles import RAW_REGISTRATION_SQL, SCORED_SQL, raw_registration, scored
from riskmart.operators import metrics, profile, ranking, stats
from riskmart.operators.running import exact_quantiles


def _pct(num: str, den: str) -> str:
    return f"CAST(round(CAST(100 * ({num}) AS DECIMAL(28,9)) / ({den}), 2) AS DOUBLE)"


@query("profile_freq", f"""
SELECT o_orderpriority, count(*) AS qtd_absoluto,
       CAST(round(CAST(100.0 * count(*) / (SELECT count(*) FROM orders) AS DECIMAL(28,9)), 2) AS DOUBLE) AS qtd_percentual
FROM orders GROUP BY o_orderpriority""")
def _(t):
    return profile.frequency(t.orders, "o_orderpriority")


@query("profile_freq_top", """
SELECT l_suppkey, count(*) AS qtd_absoluto,
       CAST(round(CAST(100.0 * count(*) / (SELECT count(*) FROM lineitem) AS DECIMAL(28,9)), 2) AS DOUBLE) AS qtd_percentual
FROM lineitem GROUP BY l_suppkey ORDER BY qtd_absoluto DESC, l_suppkey LIMIT 20""")
def _(t):
    return profile.frequency(t.lineitem, "l_suppkey", top=20)


@query("profile_freq_sql", """
SELECT l_returnflag AS value, count(*) AS qtd_absoluto,
       CAST(round(CAST(100.0 * count(*) / (SELECT count(*) FROM lineitem) AS DECIMAL(28,9)), 2) AS DOUBLE) AS qtd_percentual
FROM lineitem GROUP BY l_returnflag""")
def _(t):
    t.lineitem.createOrReplaceTempView("profile_lineitem")
    return profile.frequency_sql(t.spark, "profile_lineitem", "l_returnflag")


_NULLABLE = ["var_02", "var_03", "var_04", "var_07", "var_08", "var_10", "var_12", "var_15", "var_25", "FPD", "PROD"]


@query("profile_nulls", " UNION ALL ".join(f"""
SELECT '{c}' AS coluna, count(*) - count({c}) AS qtd_nulos,
  CAST(round(CAST(100.0 * (count(*) - count({c})) / count(*) AS DECIMAL(28,9)), 2) AS DOUBLE) AS pct_nulos
FROM ({RAW_REGISTRATION_SQL})""" for c in _NULLABLE))
def _(t):
    return profile.null_profile(raw_registration(t).select(*_NULLABLE))


@query("profile_shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def _(t):
    return profile.shape(t.lineitem)


@query("profile_compare", """
WITH a AS (SELECT count(*) AS n, avg(CAST(l_returnflag = 'R' AS DOUBLE)) AS r FROM lineitem),
b AS (SELECT count(*) AS n, avg(CAST(l_returnflag = 'R' AS DOUBLE)) AS r FROM lineitem WHERE l_discount > 0.02)
SELECT a.n AS rows_1, 2 AS columns_1, round(a.r * 100, 4) AS rate_1_pct, b.n AS rows_2, 2 AS columns_2,
  round(b.r * 100, 4) AS rate_2_pct, a.n - b.n AS rows_removed,
  CAST(round(CAST(100.0 * (a.n - b.n) / a.n AS DECIMAL(28,9)), 2) AS DOUBLE) AS rows_removed_pct,
  round((a.r - b.r) * 100, 4) AS rate_change_points FROM a, b""")
def _(t):
    df = t.lineitem.select("l_discount", (F.col("l_returnflag") == "R").cast("int").alias("alvo"))
    return profile.compare(df, df.where("l_discount > 0.02"), "alvo")


@query("profile_unique", """
SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, count(DISTINCT o_custkey) AS n_customers,
       count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders""")
def _(t):
    return profile.uniqueness(t.orders, "o_orderkey", "o_custkey")


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_summary", " UNION ALL ".join(f"""
SELECT '{c}' AS coluna, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, min({c}) AS min,
  max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75 FROM lineitem""" for c in _NUMBERS))
def _(t):
    out = profile.summary(t.lineitem, _NUMBERS)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stddev", "p25", "p50", "p75")})


@query("profile_scalar", """
SELECT min(o_totalprice) AS lowest, round(avg(o_totalprice), 6) AS average FROM orders""")
def _(t):
    return t.orders.agg(F.min("o_totalprice").alias("lowest"), F.round(F.avg("o_totalprice"), 6).alias("average"))


@query("profile_category_rate", f"""
SELECT STATUSRF, count(FPD) AS volume, sum(FPD) / count(FPD) * 100 AS rate_pct FROM ({RAW_REGISTRATION_SQL}) GROUP BY STATUSRF""")
def _(t):
    return profile.category_rate(raw_registration(t), "STATUSRF", "FPD")


@query("profile_crosstab", """
SELECT o_orderpriority, count(*) AS total, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*) * 100 AS pct_F,
  sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) / count(*) * 100 AS pct_O,
  sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) / count(*) * 100 AS pct_P FROM orders GROUP BY o_orderpriority""")
def _(t):
    return profile.crosstab_share(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("profile_segments", f"""
WITH d AS (SELECT FPD, CASE WHEN var_20 = 'FUNC_PUBL' THEN 1 ELSE 0 END AS publico, CAST(var_22 IS NOT NULL AS INTEGER) AS diretor,
  CAST(var_23 IS NOT NULL AS INTEGER) AS bolsa FROM ({RAW_REGISTRATION_SQL}))
SELECT 'Func. Público' AS segment, count(*) AS volume, avg(FPD) * 100 AS rate_pct FROM d WHERE publico = 1
UNION ALL SELECT 'Diretor', count(*), avg(FPD) * 100 FROM d WHERE diretor = 1
UNION ALL SELECT 'bolsa', count(*), avg(FPD) * 100 FROM d WHERE bolsa = 1""")
def _(t):
    from riskmart.functions.values import presence_flag
    df = raw_registration(t).select("FPD", presence_flag("var_20", "FUNC_PUBL").alias("publico"),
                                    presence_flag("var_22").alias("diretor"), presence_flag("var_23").alias("bolsa"))
    return profile.segments(df, ["publico", "diretor", "bolsa"], "FPD", {"publico": "Func. Público", "diretor": "Diretor"})


@query("profile_distinct", "SELECT DISTINCT p_brand FROM part")
def _(t):
    return profile.distinct_values(t.part, "p_brand")


@query("profile_median", "SELECT median(o_totalprice) AS median FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return profile.median(t.orders, "o_totalprice", F.col("o_orderstatus") == "F")


@query("profile_quantiles_by_group", """
SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.1), 6) AS p10, round(quantile_cont(o_totalprice, 0.9), 6) AS p90
FROM orders GROUP BY o_orderstatus""")
def _(t):
    out = exact_quantiles(t.orders, "o_totalprice", [0.1, 0.9], by=["o_orderstatus"], names=["p10", "p90"])
    return out.withColumns({c: F.round(c, 6) for c in ("p10", "p90")})


@query("profile_target_share", f"""
SELECT FPD, count(*) AS n_rows, count(*) / (SELECT count(*) FROM ({RAW_REGISTRATION_SQL})) * 100 AS share_pct
FROM ({RAW_REGISTRATION_SQL}) GROUP BY FPD""")
def _(t):
    return profile.target_share(raw_registration(t), "FPD")


@query("stat_histogram", """
WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
d AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, lo, hi FROM orders, m)
SELECT bin, lo + bin * ((hi - lo) / 30) AS lower, lo + (bin + 1) * ((hi - lo) / 30) AS upper, count(*) AS n,
  count(*) / (SELECT count(*) FROM orders) / ((hi - lo) / 30) AS density FROM d GROUP BY bin, lo, hi""")
def _(t):
    return profile.histogram(t.orders, "o_totalprice", 30)


# --- windows over reports and populations ------------------------------------

@query("win_cumulative_rates", f"""
WITH c AS (SELECT p, CAST(sum(y_true) AS BIGINT) AS bad, CAST(sum(1 - y_true) AS BIGINT) AS good FROM ({SCORED_SQL}) GROUP BY p),
w AS (SELECT *, sum(bad) OVER (ORDER BY p DESC) AS cb, sum(good) OVER (ORDER BY p DESC) AS cg, sum(bad) OVER () AS tb,
  sum(good) OVER () AS tg FROM c)
SELECT p, bad, good, CAST(cb AS DOUBLE) / CAST(tb AS DOUBLE) AS cum_bad_rate, CAST(cg AS DOUBLE) / CAST(tg AS DOUBLE) AS cum_good_rate,
  abs(CAST(cb AS DOUBLE) / CAST(tb AS DOUBLE) - CAST(cg AS DOUBLE) / CAST(tg AS DOUBLE)) AS gap FROM w""")
def _(t):
    return metrics.cumulative_rates(scored(t), "y_true", "p")


_BRANDS = "SELECT p_brand AS feature, CAST(sum(p_size) AS BIGINT) AS peso FROM part GROUP BY p_brand"


def _brands(t):
    return t.part.groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_size").alias("peso"))


@query("win_rank_cumshare", f"""
WITH b AS ({_BRANDS}), n AS (SELECT feature, peso / (SELECT sum(peso) FROM b) AS importance FROM b)
SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS ranking,
  round(sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING), 9) AS acumulado FROM n""")
def _(t):
    b = _brands(t)
    n = b.select("feature", (F.col("peso") / b.agg(F.sum("peso")).scalar()).alias("importance"))
    out = ranking.cumulative_share(ranking.rank_by(n, "importance", "feature"), "importance", "feature")
    return out.withColumn("acumulado", F.round("acumulado", 9))


@query("win_delta_prev", """
WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS etapa, o_orderstatus AS modelo,
   CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS ks FROM orders GROUP BY ALL)
SELECT *, coalesce(lag(ks) OVER (PARTITION BY modelo ORDER BY etapa), 0.0) AS ks_anterior,
  ks - coalesce(lag(ks) OVER (PARTITION BY modelo ORDER BY etapa), 0.0) AS delta_ks FROM y""")
def _(t):
    y = t.orders.groupBy(F.year("o_orderdate").alias("etapa"), F.col("o_orderstatus").alias("modelo")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("ks"))
    return metrics.with_delta(y)


@query("win_percentile_axis", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position,
  row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) / (SELECT count(*) FROM orders) * 100 AS pct FROM orders""")
def _(t):
    from riskmart.operators.running import row_positions
    out = row_positions(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")
    return out.select("o_orderkey", "position", (F.col("position") / F.col("n_rows") * 100).alias("pct"))


@query("win_decile_bins", """
WITH d AS (SELECT CASE WHEN l_linenumber = 7 THEN -1 ELSE l_extendedprice END AS s, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
e AS (SELECT unnest(range(11)) AS i, unnest(quantile_cont(s, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS v FROM d WHERE s <> -1),
b AS (SELECT CASE WHEN s = -1 THEN 0 ELSE (SELECT greatest(count(*), 1) FROM e WHERE e.v < s) END AS bin, y FROM d)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo.v, 6) AS lower, round(hi.v, 6) AS upper, count(*) AS volume, sum(y) / count(*) * 100 AS rate_pct
FROM b LEFT JOIN e lo ON lo.i = b.bin - 1 AND b.bin > 0 LEFT JOIN e hi ON hi.i = b.bin AND b.bin > 0 GROUP BY ALL""")
def _(t):
    df = t.lineitem.select(F.when(F.col("l_linenumber") == 7, F.lit(-1.0)).otherwise(F.col("l_extendedprice")).alias("s"),
                           (F.col("l_returnflag") == "R").cast("int").alias("y"))
    out = profile.decile_bins(df, "s", "y", sentinel=-1)
    return out.withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


@query("win_decile_bins_ties", """
WITH d AS (SELECT l_discount AS s, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
q AS (SELECT DISTINCT unnest(quantile_cont(s, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS v FROM d),
e AS (SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS i, v FROM q),
b AS (SELECT (SELECT greatest(count(*), 1) FROM e WHERE e.v < s) AS bin, y FROM d)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo.v, 6) AS lower, round(hi.v, 6) AS upper, count(*) AS volume, sum(y) / count(*) * 100 AS rate_pct
FROM b JOIN e lo ON lo.i = b.bin - 1 JOIN e hi ON hi.i = b.bin GROUP BY ALL""")
def _(t):
    df = t.lineitem.select(F.col("l_discount").alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    out = profile.decile_bins(df, "s", "y")
    return out.withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


@query("win_average_rank", """
SELECT p_size, count(*) AS n, any_value(r) + (count(*) - 1) / 2 AS rank
FROM (SELECT p_size, rank() OVER (ORDER BY p_size) AS r FROM part) GROUP BY p_size""")
def _(t):
    return stats.average_ranks(t.part, "p_size")


# --- sorts and top lists -----------------------------------------------------

@query("sort_nulls_last", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS etapa, o_custkey FROM orders
ORDER BY etapa NULLS LAST, o_custkey, o_orderkey""")
def _(t):
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("etapa"), "o_custkey")
    return df.orderBy(F.col("etapa").asc_nulls_last(), "o_custkey", "o_orderkey")


@query("topk_features", f"SELECT feature, peso FROM ({_BRANDS}) ORDER BY peso DESC, feature LIMIT 10")
def _(t):
    return ranking.top_n(_brands(t), "peso", 10, ties=["feature"])


@query("sort_argmax", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""")
def _(t):
    return ranking.argmax_row(t.orders, F.col("o_totalprice"), [-F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query("sort_vintages_by_volume", f"""
SELECT vintage, count(*) AS volume FROM ({SCORED_SQL}) GROUP BY vintage""")
def _(t):
    return scored(t).groupBy("vintage").agg(F.count("*").alias("volume")).orderBy("volume", "vintage")
