"""Driver tables in the roles of the feature mart, as Spark frames and as SQL text.

Role expressions are plain SQL that both engines read alike; they only rename and
derive input columns, the operators under test never appear here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.catalogue import Tables
from riskmart.operators import history as H

WEEKS = {20240108: "2024-01-08", 20240115: "2024-01-15", 20240122: "2024-01-22", 20240129: "2024-01-29",
         20240201: "2024-02-01"}
MONTHS = {y * 100 + m: f"{y}-{m:02d}-01" for y in (2000, 2001) for m in range(1, 13) if (y, m) <= (2001, 7)}
VINTAGES = {v: MONTHS[v] for v in (200010, 200011, 200012, 200101, 200102, 200103)}
OOT = [200102, 200103]


def _spine_sql(cutoffs: dict[int, str], customer: str = "c_custkey") -> str:
    values = ", ".join(f"({v}, DATE '{d}')" for v, d in cutoffs.items())
    return (f"SELECT {customer} AS NUM_CPF, v.SAFRA, v.CUT, CAST({customer} AS VARCHAR) || CAST(v.SAFRA AS VARCHAR) "
            f"AS ID_UNICO FROM customer, (VALUES {values}) v(SAFRA, CUT)")


def weekly_spine(t: Tables) -> DataFrame:
    return H.spine_at(t.customer, "c_custkey", WEEKS)


def monthly_spine(t: Tables) -> DataFrame:
    return H.spine_at(t.customer, "c_custkey", MONTHS)


WEEKLY_SPINE = _spine_sql(WEEKS)
MONTHLY_SPINE = _spine_sql(MONTHS)

# --- recharge role: events ---------------------------------------------------
RECHARGE = {
    "NUM_CPF": "user_id",
    "DW_NUM_NTC": "k",
    "DAT_INSERCAO_CREDITO": "CAST(ts AS DATE)",
    "HOR_INSERCAO_CREDITO": "CAST(hour(ts) * 10000 + minute(ts) * 100 + floor(second(ts)) AS INT)",
    "VAL_CREDITO_INSERIDO": "value",
    "FLAG_SOS": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
    "VALOR_SOS": "CASE WHEN event_type = 'error' THEN CAST(k AS DOUBLE) / 4 ELSE 0 END",
    "COD_GRUPO_CARTAO": "CASE k % 4 WHEN 0 THEN 'UB' WHEN 1 THEN '-2' WHEN 2 THEN 'WT' ELSE 'QQ' END",
    "DSC_GRUPO_CARTAO_WPP": "CASE event_type WHEN 'click' THEN 'Rec.Online' WHEN 'view' THEN 'NaoSeAplica' "
                            "WHEN 'signup' THEN '-2' WHEN 'error' THEN 'ChipPre+R$30' ELSE 'Loja' END",
    "DSC_CANAL_AQUISICAO": "CASE event_type WHEN 'click' THEN 'Epay web' WHEN 'view' THEN 'banco inter' "
                           "WHEN 'purchase' THEN 'Loja Bradesco' WHEN 'signup' THEN 'NI' ELSE 'Portal' END",
    "DSC_PLANO_PRECO": "CASE k % 6 WHEN 0 THEN 'Prezao 10' WHEN 1 THEN 'cont35' WHEN 2 THEN 'ZB7 sul' "
                       "WHEN 3 THEN 'Toda Hora' WHEN 4 THEN '-4' ELSE 'Avulso' END",
    "DSC_PLATAFORMA_BI": "CASE WHEN k % 10 = 9 THEN NULL ELSE event_type END",
    "DSC_TIPO_RECARGA": "CASE WHEN k < 50 THEN 'PRÉ-PAGO' ELSE 'PRÉ PAGO' END",
    "DSC_TIPO_INSTITUICAO": "CASE WHEN k % 3 = 0 THEN NULL ELSE 'BANCO' END",
    "DSC_GRUPO_PLATAFORMA": "CASE k % 4 WHEN 0 THEN 'Pré Pago' WHEN 1 THEN 'Controle' WHEN 2 THEN 'Pós Pago' "
                            "ELSE NULL END",
}


def _columns(role: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in role.items())


def recharge_rows(t: Tables) -> DataFrame:
    events = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return events.selectExpr(*[f"{e} AS {n}" for n, e in RECHARGE.items()])


RECHARGE_SQL = (f"SELECT {_columns(RECHARGE)} FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k "
                f"FROM events)")

# --- payment role: line items with their orders ------------------------------
PAYMENT = {
    "NUM_CPF": "o_custkey",
    "DW_NUM_CLIENTE": "o_orderkey",
    "SEQ_FATURA": "l_linenumber",
    "DAT_STATUS_FATURA": "CAST(l_shipdate AS DATE)",
    "DAT_CRIACAO_PAGAMENTO": "CASE WHEN l_linenumber = 7 THEN DATE '1900-01-01' ELSE CAST(l_shipdate AS DATE) END",
    "DAT_STATUS_PAGAMENTO": "CASE WHEN l_linenumber = 7 THEN DATE '1900-01-01' ELSE CAST(l_shipdate AS DATE) END",
    "DAT_VENCIMENTO_CREDITO": "CASE WHEN o_orderpriority = '1-URGENT' THEN DATE '9999-12-31' "
                              "ELSE CAST(o_orderdate AS DATE) END",
    "VAL_PAGAMENTO_FATURA": "l_extendedprice",
    "VAL_JUROS_MULTAS_ITEM": "l_tax * l_quantity * 20",
    "IND_STATUS_FATURA": "l_returnflag",
    "IND_STATUS_PAGAMENTO": "CASE WHEN l_linenumber = 6 THEN '-4' ELSE l_linestatus END",
    "DW_FORMA_PAGAMENTO": "CAST(10 + l_linenumber % 6 AS INT)",
    "DW_TIPO_PAGAMENTO": "o_orderstatus",
    "NUM_BANCO_PAGAMENTO": "CASE l_suppkey % 5 WHEN 0 THEN '104' WHEN 1 THEN 'MPG' WHEN 2 THEN '-3' WHEN 3 THEN 'NT1' "
                           "ELSE '999' END",
    "COD_ALOCACAO_CREDITO": "CASE l_partkey % 4 WHEN 0 THEN 'PYM' WHEN 1 THEN 'CRT' WHEN 2 THEN 'XYZ' ELSE NULL END",
    "DW_UN_NEGOCIO": "o_orderpriority",
}


def payment_rows(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in PAYMENT.items()])


PAYMENT_SQL = f"SELECT {_columns(PAYMENT)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey"

PAYMENT_DOMAINS = {
    "STAT_FAT": ["A", "N", "R"], "TIPO_PAG": ["F", "O", "P"], "STAT_PAG": ["F", "O", "DESCONHECIDO"],
    "REGIONAL": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
}
RECHARGE_DOMAINS = {"PLATAFORMA": ["click", "error", "purchase", "signup", "view"],
                    "TIPO_RECAR": ["PRÉ-PAGO", "PRÉ PAGO"]}

# --- registration, score and telco roles: customers at each vintage ----------
CPF = ("lpad(CAST({k} % 100000 AS STRING), 5, '0') || "
       "CASE {k} % 10 WHEN 0 THEN 'ZZ' WHEN 1 THEN 'ZX' ELSE 'AA' END || CAST({k} AS STRING)")


def _pick(index: str, values: list) -> str:
    cases = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {index} {cases} END"


POPULATION = {
    "NUM_CPF": CPF.format(k="k"),
    "SAFRA": "SAFRA",
    "PROD": _pick("nk % 3", list(K.PRODUCTS)),
    "FLAG_INSTALACAO": "CASE WHEN bal > 0 THEN 1 ELSE 0 END",
    "FPD": "CASE WHEN k % 7 = 0 THEN NULL WHEN bal < 2500 THEN 1 ELSE 0 END",
    "flag_mig2": _pick("k % 4", ["Aquisição", "PRE", "FLEX", None]),
}
REGISTRATION = {
    **POPULATION,
    "STATUSRF": _pick("k % 8", ["REGULAR", "PENDENTE DE REGULARIZACAO", None, "SUSPENSA", "TITULAR FALECIDO",
                                "CANCELADA", "NULA", "REGULAR"]),
    "DATADENASCIMENTO": "CASE WHEN k % 11 = 0 THEN NULL ELSE lpad(CAST(1 + k % 31 AS STRING), 2, '0') || '/' || "
                        "lpad(CAST(1 + k % 12 AS STRING), 2, '0') || '/' || CAST(1890 + (k * 37) % 110 AS STRING) END",
    "CEP_3_digitos": "CASE WHEN k % 9 = 0 THEN NULL ELSE lpad(CAST((k * 13) % 1000 AS STRING), 3, '0') END",
    "var_02": "CASE WHEN k % 5 = 0 THEN NULL ELSE bal END",
    "var_03": "CASE WHEN k % 6 = 5 THEN NULL ELSE k % 6 END",
    "var_04": "CASE WHEN k % 7 = 6 THEN NULL ELSE k % 7 END",
    "var_05": "CASE WHEN nk = 3 THEN NULL ELSE nk END",
    "var_07": "CASE WHEN k % 13 = 0 THEN NULL ELSE bal * 2000 END",
    "var_08": _pick("k % 11", [41, 42, 32, 21, 31, 91, 80, 87, 88, 99, None]),
    "var_09": "CASE WHEN k % 5 = 4 THEN NULL ELSE k % 5 END",
    "var_10": _pick("k % 3", ["ANALISTA", "TECNICO", None]),
    "var_11": "CASE WHEN k % 3 = 2 THEN NULL ELSE bal END",
    "var_12": "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 17 = 1 THEN '31/02/1999' ELSE "
              "lpad(CAST(1 + k % 28 AS STRING), 2, '0') || '/' || lpad(CAST(1 + k % 12 AS STRING), 2, '0') || '/' || "
              "CAST(1990 + k % 10 AS STRING) END",
    "var_14": "CASE WHEN k % 8 = 0 THEN NULL ELSE k % 8 END",
    "var_15": "CASE WHEN k % 3 = 0 THEN NULL ELSE " + _pick("k % 27", K.STATES) + " END",
    "var_16": "CASE WHEN k % 3 = 0 THEN NULL ELSE 100 + k % 50 END",
    "var_17": _pick("k % 5", [202003, 202107, 202311, 202402, None]),
    "var_18": _pick("k % 2", ["A", None]),
    "var_19": _pick("k % 3", ["A", None, None]),
    "var_20": _pick("k % 3", ["FUNC_PUBL", "OUTRO", None]),
    "var_21": _pick("k % 4", ["S", "S", None, None]),
    "var_22": _pick("k % 6", ["D", None, None, None, None, None]),
    "var_23": _pick("k % 5", ["B", "B", None, None, None]),
    "var_24": _pick("k % 3", ["ADMITIDO", "DISPENSADO", None]),
    "var_25": _pick("k % 4", ["CLT", "CLT INSS", "CLT  INSS PUB", None]),
}
# every customer has a row; some stand under a key that no other table knows, so later joins miss them
SCORE = {
    **POPULATION,
    "NUM_CPF": CPF.format(k="(CASE WHEN k % 6 = 5 THEN -1 - k ELSE k END)"),
    "SCORE_01": "CASE WHEN k % 10 = 3 THEN NULL ELSE (k * 97) % 1000 END",
    "SCORE_02": "CASE WHEN k % 10 = 4 THEN NULL ELSE (k * 61) % 1000 END",
}
TELCO = {
    **POPULATION,
    "NUM_CPF": CPF.format(k="(CASE WHEN k % 5 = 4 THEN -1 - k ELSE k END)"),
    **{f"var_{i}": f"CASE WHEN k % 9 = 0 THEN NULL ELSE CAST((k * {i}) % 977 AS DOUBLE) / 4 END" for i in range(26, 78)},
    **{f"var_{i}": f"(k + {i}) * 31 % 15000" for i in range(78, 94)},
}


def _people(t: Tables) -> DataFrame:
    """Customers at every vintage; dealt out first, as the customer table is a short file and each row becomes several wide ones."""
    cores = max(t.spark.sparkContext.defaultParallelism, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    return t.customer.select("c_custkey", "c_acctbal", "c_nationkey").repartition(cores, "c_custkey").select(
        F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nk"),
        F.explode(F.array(*[F.lit(v) for v in VINTAGES])).alias("SAFRA"))


PEOPLE_SQL = ("SELECT c_custkey AS k, c_acctbal AS bal, c_nationkey AS nk, v.SAFRA FROM customer, (VALUES "
              + ", ".join(f"({v})" for v in VINTAGES) + ") v(SAFRA)")


def raw_registration(t: Tables) -> DataFrame:
    return _people(t).selectExpr(*[f"{e} AS {n}" for n, e in REGISTRATION.items()])


def raw_score(t: Tables) -> DataFrame:
    return _people(t).selectExpr(*[f"{e} AS {n}" for n, e in SCORE.items()])


def raw_telco(t: Tables) -> DataFrame:
    return _people(t).selectExpr(*[f"{e} AS {n}" for n, e in TELCO.items()])


RAW_REGISTRATION_SQL = f"SELECT {_columns(REGISTRATION)} FROM ({PEOPLE_SQL})"
RAW_SCORE_SQL = f"SELECT {_columns(SCORE)} FROM ({PEOPLE_SQL})"
RAW_TELCO_SQL = f"SELECT {_columns(TELCO)} FROM ({PEOPLE_SQL})"

# recharge role for the base table: orders (same years as the payments)
ORDER_RECHARGE = {
    "NUM_CPF": CPF.format(k="o_custkey"),
    "DW_NUM_NTC": "o_orderkey % 3",
    "DAT_INSERCAO_CREDITO": "CAST(o_orderdate AS DATE)",
    "HOR_INSERCAO_CREDITO": "CAST((o_orderkey % 24) * 10000 AS INT)",
    "VAL_CREDITO_INSERIDO": "o_totalprice",
    "FLAG_SOS": "CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END",
    "VALOR_SOS": "CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey % 100 AS DOUBLE) / 4 ELSE 0 END",
    "COD_GRUPO_CARTAO": "CASE o_orderkey % 4 WHEN 0 THEN 'UB' WHEN 1 THEN '-2' WHEN 2 THEN 'WT' ELSE 'QQ' END",
    "DSC_GRUPO_CARTAO_WPP": "CASE o_orderkey % 3 WHEN 0 THEN 'Rec.Online' WHEN 1 THEN '-2' ELSE 'Loja' END",
    "DSC_CANAL_AQUISICAO": "CASE o_orderpriority WHEN '1-URGENT' THEN 'NI' WHEN '2-HIGH' THEN 'Itau sul' ELSE 'Portal' END",
    "DSC_PLANO_PRECO": "CASE o_orderkey % 3 WHEN 0 THEN 'Prezao 10' WHEN 1 THEN 'CONTROLE 4' ELSE 'Avulso' END",
    "DSC_PLATAFORMA_BI": "o_orderstatus",
    "DSC_TIPO_RECARGA": "CASE WHEN o_orderkey % 2 = 0 THEN 'Online' ELSE 'Loja' END",
    "DSC_TIPO_INSTITUICAO": "CAST(NULL AS STRING)",
}
ORDER_DOMAINS = {"PLATAFORMA": ["F", "O", "P"], "TIPO_RECAR": ["Online", "Loja"]}


def order_recharges(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*[f"{e} AS {n}" for n, e in ORDER_RECHARGE.items()])


def customer_payments(t: Tables) -> DataFrame:
    return payment_rows(t).withColumn("NUM_CPF", F.expr(CPF.format(k="NUM_CPF")))


ORDER_RECHARGE_SQL = f"SELECT {_columns(ORDER_RECHARGE)} FROM orders"
CUSTOMER_PAYMENT_SQL = f"SELECT * REPLACE ({CPF.format(k='NUM_CPF')} AS NUM_CPF) FROM ({PAYMENT_SQL})"

# --- scored role: line items -------------------------------------------------
# bad = returned, score = discount (11 values) or a spread-out score, policy = order line open
SCORED = {
    "y_true": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "p": "l_discount",
    "p2": "((l_partkey * 7919 + l_suppkey * 104729 + l_orderkey * 31) % 1000003) / CAST(1000003 AS DOUBLE)",
    "flag": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END",
    "vintage": "CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT)",
}


def scored(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(*[f"{e} AS {n}" for n, e in SCORED.items()])


SCORED_SQL = f"SELECT {_columns(SCORED)} FROM lineitem"

# the same role on orders, whose key is unique
SCORED_ORDERS = {
    "id": "o_orderkey",
    "y_true": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "p": "floor(o_totalprice / 50000)",
    "p2": "o_totalprice",
    "vintage": "CAST(year(o_orderdate) AS INT)",
}


def scored_orders(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*[f"{e} AS {n}" for n, e in SCORED_ORDERS.items()])


SCORED_ORDERS_SQL = f"SELECT {_columns(SCORED_ORDERS)} FROM orders"
