"""Raw text tables through the conform plans: telco, recharge, payment, a dimension."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.catalogue import plain, plain_sql, query
from riskmart.catalogue.roles import CPF, RAW_TELCO_SQL, _columns, raw_telco
from riskmart.plans import silver

_MONTHS = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(
    "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1))


def _stamp(day: str) -> str:
    """Date as ``ddMMMyyyy:HH:mm:ss`` text, in SQL both engines read."""
    return (f"lpad(CAST(day({day}) AS STRING), 2, '0') || CASE month({day}) {_MONTHS} END || "
            f"CAST(year({day}) AS STRING) || ':00:00:00'")


RECHARGE_TEXT = {
    "NUM_CPF": CPF.format(k="user_id"), "DW_NUM_NTC": "CASE WHEN event_id % 9 = 0 THEN 'x' ELSE CAST(event_id AS STRING) END",
    "DW_NUM_CLIENTE": "CAST(user_id AS STRING)", "DAT_INSERCAO_CREDITO": _stamp("ts"),
    "HOR_INSERCAO_CREDITO": "CAST(event_id % 240000 AS STRING)", "VAL_CREDITO_INSERIDO": "CAST(value AS STRING)",
    "VAL_BONUS": "CASE WHEN event_type = 'view' THEN 'n/a' ELSE '1.5' END", "VAL_REAL": "CAST(value AS STRING)",
    "FLAG_SOS": "CASE WHEN event_type = 'error' THEN '1' ELSE '0' END",
    "VALOR_SOS": "CASE WHEN event_type = 'error' THEN '3.5' END",
    "DW_TIPO_RECARGA": "CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 3 AS STRING) END",
    "DW_PLANO_TARIFACAO": "CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 5 AS STRING) END",
    "COD_PROMOCAO": "CAST(NULL AS STRING)", "COD_CANAL_AQUISICAO": "CAST(event_id % 7 AS STRING)", "DW_TIPO_INSERCAO": "'1'",
    "DW_FORMA_PAGAMENTO": "'2'", "DW_INSTITUICAO": "'-1'",
}
_RECHARGE_CASTS = {
    **{c: ("INTEGER", None) for c in ("COD_CANAL_AQUISICAO", "HOR_INSERCAO_CREDITO", "DW_TIPO_INSERCAO", "DW_FORMA_PAGAMENTO",
                                      "DW_INSTITUICAO", "FLAG_SOS")},
    **{c: ("BIGINT", None) for c in ("DW_NUM_NTC", "DW_NUM_CLIENTE")},
    **{c: ("FLOAT", None) for c in ("VAL_CREDITO_INSERIDO", "VAL_BONUS", "VAL_REAL")},
    **{c: ("INTEGER", -4) for c in ("DW_TIPO_RECARGA", "DW_PLANO_TARIFACAO", "COD_PROMOCAO")}, "VALOR_SOS": ("FLOAT", 0),
}


def _cast(c: str, kind: str, default) -> str:
    made = f"TRY_CAST({c} AS {kind})"
    return f"{made if default is None else f'coalesce({made}, CAST({default} AS {kind}))'} AS {c}"


def _date(c: str, default: str | None) -> str:
    made = f"CAST(try_strptime({c}, '%d%b%Y:%H:%M:%S') AS DATE)"
    return made if default is None else f"coalesce({made}, DATE '{default}')"


_GC = "substr(NUM_CPF, 6, 2) IN ('ZZ', 'ZX') AS GRUPO_CONTROLE"


@query("conform_recharge_table", plain_sql(f"""
SELECT *, CAST(year(DAT_INSERCAO_CREDITO) AS INTEGER) AS ANO_INSERCAO, CAST(month(DAT_INSERCAO_CREDITO) AS INTEGER) AS MES_INSERCAO FROM (
SELECT NUM_CPF, {_GC}, {_date('DAT_INSERCAO_CREDITO', None)} AS DAT_INSERCAO_CREDITO,
  {', '.join(_cast(c, k, d) for c, (k, d) in _RECHARGE_CASTS.items())} FROM (SELECT {_columns(RECHARGE_TEXT)} FROM events))""",
    ["VAL_CREDITO_INSERIDO", "VAL_BONUS", "VAL_REAL", "VALOR_SOS"]))
def _(t):
    return plain(silver.recharge(t.events.selectExpr(*[f"{e} AS {n}" for n, e in RECHARGE_TEXT.items()])))


PAYMENT_TEXT = {
    "NUM_CPF": CPF.format(k="o_custkey"), "DW_NUM_CLIENTE": "CAST(o_orderkey AS STRING)", "SEQ_FATURA": "CAST(l_linenumber AS STRING)",
    "DAT_STATUS_FATURA": _stamp("l_shipdate"),
    "DAT_CRIACAO_PAGAMENTO": f"CASE WHEN l_linenumber = 7 THEN NULL ELSE {_stamp('l_shipdate')} END",
    "DAT_VENCIMENTO_CREDITO": f"CASE WHEN o_orderstatus = 'P' THEN '31FEB2000:00:00:00' ELSE {_stamp('o_orderdate')} END",
    "DAT_BAIXA_ATIVIDADE": "CAST(NULL AS STRING)",
    "DAT_ATUALIZACAO_PAGAMENTO": f"CASE WHEN l_linenumber < 3 THEN NULL ELSE {_stamp('o_orderdate')} END",
    "VAL_ATUAL_PAGAMENTO": "CASE WHEN l_linestatus = 'O' THEN NULL ELSE CAST(l_quantity AS STRING) END",
    "VAL_BAIXA_ATIVIDADE": "CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS STRING) END",
    "VAL_JUROS_MULTAS_ITEM": "CASE WHEN l_tax > 0 THEN CAST(l_tax AS STRING) END",
    "SEQ_FATURA_CREDITO": "CASE WHEN l_partkey % 4 > 0 THEN CAST(l_partkey AS STRING) END",
    "NUM_PARCELA_PAGAMENTO": "CASE WHEN l_suppkey % 4 > 0 THEN CAST(l_suppkey % 4 AS STRING) END",
    "COD_ALOCACAO_CREDITO": "CASE WHEN l_partkey % 3 > 0 THEN 'PYM' END", "IND_STATUS_PAGAMENTO": "CASE WHEN l_partkey % 5 > 0 THEN 'B' END",
    "COD_LOGIN_PAGAMENTO": "CASE WHEN l_partkey % 2 > 0 THEN 'abc' END",
}
_PAYMENT_MADE = [
    *[f"CAST({c} IS NULL AS INTEGER) AS \"{n}\"" for n, c in {
        "NUM_PARCELA_PAGAMENTO_MISSING": "NUM_PARCELA_PAGAMENTO", "DAT_ATUALIZACAO_PAGAMENTO_MISSING": "DAT_ATUALIZACAO_PAGAMENTO",
        "COD_LOGIN_PAGAMENTO_MISSING": "COD_LOGIN_PAGAMENTO", "VAL_ATUAL_PAGAMENTO_MISSING": "VAL_ATUAL_PAGAMENTO",
        "BLOCO_28-03-percet_MISSING": "SEQ_FATURA_CREDITO"}.items()],
    *[f"{_date(c, d)} AS {c}" for c, d in {
        "DAT_STATUS_FATURA": None, "DAT_CRIACAO_PAGAMENTO": K.OPEN_START, "DAT_VENCIMENTO_CREDITO": K.OPEN_END,
        "DAT_BAIXA_ATIVIDADE": K.OPEN_END, "DAT_ATUALIZACAO_PAGAMENTO": K.OPEN_START}.items()],
    *[_cast(c, "FLOAT", d) for c, d in {"VAL_ATUAL_PAGAMENTO": -4, "VAL_BAIXA_ATIVIDADE": -444444, "VAL_JUROS_MULTAS_ITEM": 0}.items()],
    *[_cast(c, "INTEGER", -4) for c in ("SEQ_FATURA_CREDITO", "NUM_PARCELA_PAGAMENTO", "COD_LOGIN_PAGAMENTO")],
    "coalesce(COD_ALOCACAO_CREDITO, 'DESCONHECIDO') AS COD_ALOCACAO_CREDITO", "coalesce(IND_STATUS_PAGAMENTO, '-4') AS IND_STATUS_PAGAMENTO",
]


_OPEN_DATES = ("DAT_CRIACAO_PAGAMENTO", "DAT_VENCIMENTO_CREDITO", "DAT_BAIXA_ATIVIDADE", "DAT_ATUALIZACAO_PAGAMENTO")


@query("conform_payment_table", plain_sql(f"""
SELECT *, CAST(year(DAT_STATUS_FATURA) AS INTEGER) AS ANO_FATURA, CAST(month(DAT_STATUS_FATURA) AS INTEGER) AS MES_FATURA FROM (
SELECT NUM_CPF, {_GC}, DW_NUM_CLIENTE, SEQ_FATURA, {', '.join(_PAYMENT_MADE)}
FROM (SELECT {_columns(PAYMENT_TEXT)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey))""",
    ["VAL_ATUAL_PAGAMENTO", "VAL_BAIXA_ATIVIDADE", "VAL_JUROS_MULTAS_ITEM"], _OPEN_DATES))
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return plain(silver.payment(rows.selectExpr(*[f"{e} AS {n}" for n, e in PAYMENT_TEXT.items()])), _OPEN_DATES)


@query("conform_telco_table", plain_sql(f"""
SELECT NUM_CPF || CAST(SAFRA AS VARCHAR) AS ID_UNICO, {_GC}, * EXCLUDE (flag_mig2, {', '.join(silver.TELCO_VARS)}),
  coalesce(flag_mig2, 'SEM_MIGRACAO') AS flag_mig2, CAST(var_26 IS NULL AS INTEGER) AS var26_a_var77_MISSING,
  {', '.join(f'CAST(coalesce(CAST({v} AS DECIMAL(18,2)), -999) AS DECIMAL(18,2)) AS {v}' for v in silver.TELCO_VARS)} FROM ({RAW_TELCO_SQL})""",
    silver.TELCO_VARS))
def _(t):
    return plain(silver.telco(raw_telco(t)))


DIMENSION_TEXT = {
    "DW_TIPO_RECARGA": "n_nationkey", "DSC_TIPO_RECARGA": "n_name",
    "DAT_EXPIRACAO_DW": f"CASE WHEN n_regionkey = 1 THEN {_stamp('DATE ' + repr('2020-02-29'))} END",
    "DAT_CRIACAO_DW": f"CASE WHEN n_regionkey = 2 THEN 'bad' ELSE {_stamp('DATE ' + repr('2010-05-07'))} END",
}


@query("conform_dimension_table", plain_sql(f"""
SELECT DW_TIPO_RECARGA, DSC_TIPO_RECARGA, {_date('DAT_EXPIRACAO_DW', K.OPEN_END)} AS DAT_EXPIRACAO_DW,
  {_date('DAT_CRIACAO_DW', None)} AS DAT_CRIACAO_DW FROM (SELECT {_columns(DIMENSION_TEXT)} FROM nation)
UNION ALL SELECT -4, 'DESCONHECIDO', DATE '9999-12-31', DATE '1900-01-01'""",
    texts=("DAT_EXPIRACAO_DW",)))
def _(t):
    dim = silver.dimension(t.nation.selectExpr(*[f"{e} AS {n}" for n, e in DIMENSION_TEXT.items()]), "tipo_recarga")
    return plain(dim, ("DAT_EXPIRACAO_DW",))
