"""Dimension, range and step joins, fills and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.catalogue import query
from riskmart.catalogue.encoding import (BANK_SQL, CARD_SQL, CHANNEL_SQL, DAY_PART_SQL, FORM_SQL)
from riskmart.catalogue.roles import (PAYMENT_DOMAINS, PAYMENT_SQL, RECHARGE_SQL, WEEKLY_SPINE, payment_rows,
                                      recharge_rows, weekly_spine)
from riskmart.functions import encoders as enc
from riskmart.functions.text import clean_label
from riskmart.operators import frames, history, pivot
from riskmart.plans.books import BANKS, CHANNELS, FORMS


# --- dimensions --------------------------------------------------------------

@query("dim_union_unknown", """
SELECT n_nationkey, n_name, n_regionkey FROM nation
UNION ALL SELECT -1, 'NAO SE APLICA', -1 UNION ALL SELECT -4, 'DESCONHECIDO', -4""")
def _(t):
    return frames.with_members(t.nation, [(-1, "NAO SE APLICA", -1), (-4, "DESCONHECIDO", -4)])


@query("dim_patch_by_key", """
SELECT n_nationkey, CASE n_nationkey WHEN 2 THEN 'NAO DETERMINADO' WHEN 3 THEN 'NAO INFORMADO' ELSE n_name END AS n_name,
       CASE n_nationkey WHEN 2 THEN -2 WHEN 3 THEN -3 ELSE n_regionkey END AS n_regionkey
FROM nation""")
def _(t):
    return frames.patch_by_key(t.nation, "n_nationkey", {
        "n_name": {2: "NAO DETERMINADO", 3: "NAO INFORMADO"}, "n_regionkey": {2: -2, 3: -3}})


@query("join_dims_left", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, p_brand, p_type, s_name, n_name, r_name
FROM lineitem
LEFT JOIN (SELECT * REPLACE (CASE WHEN p_size > 40 THEN -p_partkey ELSE p_partkey END AS p_partkey) FROM part) p ON p_partkey = l_partkey
LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey""")
def _(t):
    out = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    # parts above size 40 carry an unknown key, so their lines miss
    part = t.part.withColumn("l_partkey", F.when(F.col("p_size") > 40, -F.col("p_partkey")).otherwise(F.col("p_partkey")))
    out = frames.enrich(out, part, ["p_brand", "p_type"], "l_partkey", drop_key=False)
    out = frames.enrich(out, t.supplier, ["s_name", "s_nationkey"], "l_suppkey", "s_suppkey").drop("s_suppkey")
    out = frames.enrich(out, t.nation, ["n_name", "n_regionkey"], "s_nationkey", "n_nationkey").drop("n_nationkey")
    return frames.enrich(out, t.region, ["r_name"], "n_regionkey", "r_regionkey").drop("r_regionkey")


@query("join_diff_keys", """
SELECT o_orderkey, o_totalprice, c_custkey, c_mktsegment FROM orders
LEFT JOIN (SELECT * REPLACE (CASE WHEN c_nationkey >= 20 THEN -1 - c_custkey ELSE c_custkey END AS c_custkey) FROM customer) ON c_custkey = o_custkey""")
def _(t):
    return frames.enrich(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), t.customer.withColumn("c_custkey", F.when(F.col("c_nationkey") >= 20, -1 - F.col("c_custkey")).otherwise(F.col("c_custkey"))),
                         ["c_mktsegment"], "o_custkey", "c_custkey")


# --- history joins and attaches ----------------------------------------------

@query("join_spine_events_range", f"""
SELECT ID_UNICO, NUM_CPF, SAFRA, event_id, CAST(CUT - day AS INTEGER) AS DIAS
FROM ({WEEKLY_SPINE}) s JOIN (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events) e
  ON e.user_id = s.NUM_CPF AND e.day < s.CUT""")
def _(t):
    events = t.events.select("event_id", "user_id", F.to_date("ts").alias("day"))
    joined = history.events_before_by_month(weekly_spine(t), events, "user_id", "day", spine_customer=K.CUSTOMER)
    return joined.select(K.ID, K.CUSTOMER, K.VINTAGE, "event_id", F.datediff(K.CUTOFF, "day").alias("DIAS"))


#: Spending of all orders; every seventh customer's key is turned into an unknown one, which makes the misses.
_SPEND = """SELECT CASE WHEN o_custkey % 7 = 0 THEN -1 - o_custkey ELSE o_custkey END AS c_custkey, count(*) AS QTD_PEDIDOS,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS var_total FROM orders GROUP BY o_custkey"""


def _spend(t):
    known = F.when(F.col("o_custkey") % 7 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey"))
    return (t.orders.groupBy(known.alias("c_custkey"))
            .agg(F.count("*").alias("QTD_PEDIDOS"),
                 F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("var_total")))


@query("join_left_attach", f"""
SELECT c.c_custkey, c_mktsegment, QTD_PEDIDOS, var_total FROM customer c LEFT JOIN ({_SPEND}) s ON s.c_custkey = c.c_custkey""")
def _(t):
    return frames.attach(t.customer.select("c_custkey", "c_mktsegment"), _spend(t), key="c_custkey")


@query("join_miss_indicator", f"""
SELECT c.c_custkey, QTD_PEDIDOS, var_total, CAST(QTD_PEDIDOS IS NULL AS INTEGER) AS SEM_HISTORICO
FROM customer c LEFT JOIN ({_SPEND}) s ON s.c_custkey = c.c_custkey""")
def _(t):
    return frames.attach(t.customer.select("c_custkey"), _spend(t), key="c_custkey", probe="QTD_PEDIDOS",
                         miss_flag="SEM_HISTORICO")


@query("join_fill_by_rule", f"""
SELECT c.c_custkey, coalesce(QTD_PEDIDOS, 0) AS QTD_PEDIDOS, coalesce(var_total, -1.0) AS var_total
FROM customer c LEFT JOIN ({_SPEND}) s ON s.c_custkey = c.c_custkey""")
def _(t):
    return frames.attach(t.customer.select("c_custkey"), _spend(t), key="c_custkey",
                         fills=lambda names: frames.fill_plan(names, 0, prefixes={"var": -1}))


@query("join_unfill_flag", f"""
SELECT c.c_custkey, coalesce(var_total, -1.0) AS var_total, coalesce(var_MISSING, 0) AS var_MISSING
FROM customer c LEFT JOIN (SELECT c_custkey, var_total, CAST(QTD_PEDIDOS > 1 AS INTEGER) AS var_MISSING FROM ({_SPEND})) s
  ON s.c_custkey = c.c_custkey""")
def _(t):
    extra = _spend(t).select("c_custkey", "var_total", (F.col("QTD_PEDIDOS") > 1).cast("int").alias("var_MISSING"))
    out = frames.attach(t.customer.select("c_custkey"), extra, key="c_custkey",
                        fills=lambda names: frames.fill_plan(names, 0, prefixes={"var": -1}))
    return frames.recode_columns(out, ["var_MISSING"], {-1: 0})


# --- pivots ------------------------------------------------------------------

def _counts(column: str, prefix: str, values, how: str = "n") -> str:
    groups: dict[str, list] = {}
    for v in values:
        groups.setdefault(f"{prefix}{clean_label(v)}", []).append(v)
    tests = {n: f"coalesce({column} IN ({', '.join(repr(v) for v in vs)}), FALSE)" for n, vs in groups.items()}
    if how == "n":
        return ", ".join(f'CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS "{n}"' for n, c in tests.items())
    return ", ".join(f'max(CASE WHEN {c} THEN 1 ELSE 0 END) AS "{n}"' for n, c in tests.items())


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("pivot_counts", f"SELECT user_id, {_counts('event_type', 'QTD_TIPO_', EVENT_TYPES)} FROM events GROUP BY user_id")
def _(t):
    return pivot.pivot_counts(t.events, "user_id", "event_type", "TIPO")


@query("pivot_flags", f"""
SELECT NUM_CPF, {_counts('DW_UN_NEGOCIO', 'FLG_REGIONAL_', PAYMENT_DOMAINS['REGIONAL'], 'flag')}
FROM ({PAYMENT_SQL}) GROUP BY NUM_CPF""")
def _(t):
    return pivot.pivot_flags(payment_rows(t), K.CUSTOMER, "DW_UN_NEGOCIO", "REGIONAL")


@query("pivot_colliding_labels", f"""
SELECT NUM_CPF, CAST(count(DSC_TIPO_RECARGA) AS BIGINT) AS "QTD_TIPO_RECAR_PR_PAGO" FROM ({RECHARGE_SQL}) GROUP BY NUM_CPF""")
def _(t):
    return pivot.pivot_counts(recharge_rows(t), K.CUSTOMER, "DSC_TIPO_RECARGA", "TIPO_RECAR")


@query("pivot_multi_fused", f"""
SELECT NUM_CPF, {_counts('forma', 'QTD_FORMA_PAG_', FORMS)}, {_counts('banco', 'QTD_BANCO_', BANKS)},
       {_counts('IND_STATUS_FATURA', 'QTD_STAT_FAT_', PAYMENT_DOMAINS['STAT_FAT'])}
FROM (SELECT *, {FORM_SQL} AS forma, {BANK_SQL} AS banco FROM ({PAYMENT_SQL})) GROUP BY NUM_CPF""")
def _(t):
    df = payment_rows(t).withColumns({"forma": enc.code_name("DW_FORMA_PAGAMENTO", K.PAYMENT_FORMS),
                                      "banco": enc.bank_cluster("NUM_BANCO_PAGAMENTO")})
    return pivot.pivot_many(df, K.CUSTOMER, {"FORMA_PAG": ("forma", FORMS), "BANCO": ("banco", BANKS),
                                             "STAT_FAT": ("IND_STATUS_FATURA", PAYMENT_DOMAINS["STAT_FAT"])})


@query("pivot_row_encoders", f"""
SELECT NUM_CPF, {_counts('turno', 'QTD_TURNO_', K.DAY_PARTS)}, {_counts('canal', 'QTD_CANAL_', CHANNELS)},
       {_counts('cartao', 'QTD_CARTAO_', [*K.TOP_CARDS, 'NAO_DETERMINADO', 'OUTROS'])}
FROM (SELECT *, {DAY_PART_SQL} AS turno, {CHANNEL_SQL} AS canal, {CARD_SQL} AS cartao FROM ({RECHARGE_SQL})) GROUP BY NUM_CPF""")
def _(t):
    df = recharge_rows(t).withColumns({
        "turno": enc.day_part("HOR_INSERCAO_CREDITO"), "canal": enc.channel_class("DSC_CANAL_AQUISICAO"),
        "cartao": enc.allow_list("COD_GRUPO_CARTAO", K.TOP_CARDS)})
    return pivot.pivot_many(df, K.CUSTOMER, {
        "TURNO": ("turno", K.DAY_PARTS), "CANAL": ("canal", CHANNELS),
        "CARTAO": ("cartao", [*K.TOP_CARDS, "NAO_DETERMINADO", "OUTROS"])})
