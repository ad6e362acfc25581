"""Business feature encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.catalogue import query
from riskmart.catalogue.roles import (RAW_REGISTRATION_SQL, RECHARGE_SQL, PAYMENT_SQL, payment_rows,
                                      raw_registration, recharge_rows, SCORED_SQL, scored)
from riskmart.functions import encoders as enc
from riskmart.functions.values import money, rounded
from riskmart.operators.pivot import discover_domain


def _hot(name: str, column: str, value) -> str:
    return f"CASE WHEN {column} = {value!r} THEN 1 ELSE 0 END AS \"{name}\""


@query("enc_one_hot", f"""
SELECT NUM_CPF, SAFRA, {', '.join(_hot(p, 'PROD', p) for p in K.PRODUCTS)},
       {', '.join(_hot(n, "coalesce(flag_mig2, 'SEM_MIGRACAO')", v) for n, v in K.MIGRATIONS.items())},
       {', '.join(_hot(f'UF_BF_{s}', 'var_15', s) for s in K.STATES)}
FROM ({RAW_REGISTRATION_SQL})""")
def _(t):
    mig = F.coalesce("flag_mig2", F.lit("SEM_MIGRACAO"))
    flags = {**enc.one_hot("PROD", {p: p for p in K.PRODUCTS}), **enc.one_hot(mig, K.MIGRATIONS),
             **enc.one_hot("var_15", {f"UF_BF_{s}": s for s in K.STATES})}
    return raw_registration(t).select("NUM_CPF", "SAFRA", *[c.alias(n) for n, c in flags.items()])


@query("enc_one_hot_domain", """
SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS SEG_AUTOMOBILE,
       CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS SEG_BUILDING, CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS SEG_FURNITURE,
       CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS SEG_MACHINERY, CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS NAO_INFORMADO
FROM customer""")
def _(t):
    domain = [v for v in discover_domain(t.customer, "c_mktsegment") if v != "HOUSEHOLD"]
    flags = enc.one_hot("c_mktsegment", domain, "SEG_")
    return t.customer.withColumns(flags).withColumn("NAO_INFORMADO", enc.none_of(list(flags))).select(
        "c_custkey", *flags, "NAO_INFORMADO")


@query("enc_age_bands", """
WITH d AS (SELECT p_partkey, CASE WHEN p_size = 50 THEN -4 ELSE p_size * 3 - 20 END AS i FROM part)
SELECT p_partkey, CAST(i = -4 AS INTEGER) AS IDADE_AUSENTE, CAST(i > 0 AND i < 30 AS INTEGER) AS IDADE_ATE_29,
       CAST(i BETWEEN 30 AND 44 AS INTEGER) AS IDADE_30_44, CAST(i BETWEEN 45 AND 60 AS INTEGER) AS IDADE_45_60,
       CAST(i BETWEEN 61 AND 99 AS INTEGER) AS IDADE_60_99, CAST(i > 99 AS INTEGER) AS IDADE_CENTENARIO FROM d""")
def _(t):
    df = t.part.select("p_partkey", F.when(F.col("p_size") == 50, -4).otherwise(F.col("p_size") * 3 - 20).alias("i"))
    return df.select("p_partkey", *[c.alias(n) for n, c in enc.age_bands("i").items()])


@query("enc_report_bands", """
SELECT p_partkey, CASE WHEN i <= -5 THEN NULL WHEN i <= 0 THEN 'Não Declarada' WHEN i <= 25 THEN 'Até 25'
       WHEN i <= 35 THEN '26-35' WHEN i <= 45 THEN '36-45' WHEN i <= 60 THEN '46-60' WHEN i <= 100 THEN '60+' END AS faixa
FROM (SELECT p_partkey, p_size * 3 - 10 AS i FROM part)""")
def _(t):
    return t.part.select("p_partkey", enc.report_age_label(F.col("p_size") * 3 - 10).alias("faixa"))


@query("enc_tenure_bands", """
SELECT p_partkey, CAST(m >= 0 AND m < 12 AS INTEGER) AS FLG_EMPREGO_CLT_NOVO_ATE_1_ANO,
       CAST(m >= 12 AND m < 36 AS INTEGER) AS FLG_EMPREGO_CLT_1_A_3_ANOS,
       CAST(m >= 36 AND m < 60 AS INTEGER) AS FLG_EMPREGO_CLT_3_A_5_ANOS, CAST(m >= 60 AS INTEGER) AS FLG_EMPREGO_CLT_MAIS_DE_5_ANOS
FROM (SELECT p_partkey, p_size * 2 - 4 AS m FROM part)""")
def _(t):
    return t.part.select("p_partkey", *[c.alias(n) for n, c in enc.tenure_bands(F.col("p_size") * 2 - 4).items()])


@query("enc_code_groups", f"""
SELECT NUM_CPF, SAFRA, CASE WHEN v IN (41, 42, 32) THEN 1 ELSE 0 END AS FLG_INSS_APOSENTADORIA_PERMANENTE,
       CASE WHEN v = 21 THEN 1 ELSE 0 END AS FLG_INSS_PENSAO_MORTE,
       CASE WHEN v IN (31, 91, 80) THEN 1 ELSE 0 END AS FLG_INSS_BENEFICIO_TEMPORARIO,
       CASE WHEN v IN (87, 88) THEN 1 ELSE 0 END AS FLG_INSS_ASSISTENCIAL_BPC_LOAS,
       CASE WHEN v NOT IN (-999, 41, 42, 32, 21, 31, 91, 80, 87, 88) THEN 1 ELSE 0 END AS outros
FROM (SELECT NUM_CPF, SAFRA, coalesce(var_08, -999) AS v FROM ({RAW_REGISTRATION_SQL}))""")
def _(t):
    flags = enc.code_groups(F.coalesce("var_08", F.lit(-999)), K.PENSION_GROUPS, "outros", [-999])
    return raw_registration(t).select("NUM_CPF", "SAFRA", *[c.alias(n) for n, c in flags.items()])


def _first_match_sql(column: str, patterns, exact: dict, otherwise: str) -> str:
    cases = " ".join(f"WHEN {column} = '{v}' THEN '{x}'" for v, x in exact.items())
    cases += " " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{x}'" for x, p in patterns)
    return f"CASE {cases} ELSE '{otherwise}' END"


CHANNEL_SQL = _first_match_sql("DSC_CANAL_AQUISICAO", K.CHANNEL_PATTERNS,
                               {"NI": "NAO INFORMADO", "ND": "NAO DECLARADO"}, "OUTROS")
PLAN_SQL = _first_match_sql("DSC_PLANO_PRECO", K.PLAN_PATTERNS, {"-4": "DESCONHECIDO"}, "NICHO/OUTROS")
DAY_PART_SQL = """CASE WHEN CAST(substr(lpad(CAST(HOR_INSERCAO_CREDITO AS VARCHAR), 6, '0'), 1, 2) AS INTEGER) < 6 THEN 'MADRUGADA'
  WHEN CAST(substr(lpad(CAST(HOR_INSERCAO_CREDITO AS VARCHAR), 6, '0'), 1, 2) AS INTEGER) < 12 THEN 'MANHA'
  WHEN CAST(substr(lpad(CAST(HOR_INSERCAO_CREDITO AS VARCHAR), 6, '0'), 1, 2) AS INTEGER) < 18 THEN 'TARDE' ELSE 'NOITE' END"""
FEE_SQL = """CASE WHEN VALOR_SOS = 0 THEN 0 WHEN VALOR_SOS <= 3 THEN 1 WHEN VALOR_SOS <= 5 THEN 2 WHEN VALOR_SOS <= 10 THEN 3.5
  WHEN VALOR_SOS <= 15 THEN 5 WHEN VALOR_SOS <= 20 THEN 6 ELSE 7 END"""
_IN = lambda xs: ", ".join(repr(x) for x in xs)
CARD_SQL = f"""CASE WHEN COD_GRUPO_CARTAO = '-2' THEN 'NAO_DETERMINADO' WHEN COD_GRUPO_CARTAO IN ({_IN(K.TOP_CARDS)})
  THEN COD_GRUPO_CARTAO ELSE 'OUTROS' END"""
ORIGIN_SQL = f"""CASE WHEN DSC_GRUPO_CARTAO_WPP = '-2' THEN 'NAO_DETERMINADO' WHEN DSC_GRUPO_CARTAO_WPP IN ({_IN(K.TOP_ORIGINS)})
  THEN DSC_GRUPO_CARTAO_WPP ELSE 'OUTROS' END"""


@query("enc_channel_regex", f"SELECT NUM_CPF, DSC_CANAL_AQUISICAO AS canal, {CHANNEL_SQL} AS classe FROM ({RECHARGE_SQL})")
def _(t):
    return recharge_rows(t).select("NUM_CPF", F.col("DSC_CANAL_AQUISICAO").alias("canal"),
                                   enc.channel_class("DSC_CANAL_AQUISICAO").alias("classe"))


@query("enc_plan_regex", f"SELECT NUM_CPF, DSC_PLANO_PRECO AS plano, {PLAN_SQL} AS grupo FROM ({RECHARGE_SQL})")
def _(t):
    return recharge_rows(t).select("NUM_CPF", F.col("DSC_PLANO_PRECO").alias("plano"),
                                   enc.plan_cluster("DSC_PLANO_PRECO").alias("grupo"))


@query("str_lpad_daypart", f"""
SELECT NUM_CPF, lpad(CAST(HOR_INSERCAO_CREDITO AS VARCHAR), 6, '0') AS hora, {DAY_PART_SQL} AS turno FROM ({RECHARGE_SQL})""")
def _(t):
    return recharge_rows(t).select("NUM_CPF", F.lpad(F.col("HOR_INSERCAO_CREDITO").cast("string"), 6, "0").alias("hora"),
                                   enc.day_part("HOR_INSERCAO_CREDITO").alias("turno"))


@query("enc_fee_tiers", f"""
SELECT NUM_CPF, VALOR_SOS, CAST({FEE_SQL} AS DOUBLE) AS taxa,
       CAST(CAST(VAL_CREDITO_INSERIDO AS DECIMAL(18,2)) - CAST(VALOR_SOS AS DECIMAL(18,2)) - CAST({FEE_SQL} AS DECIMAL(18,2)) AS DOUBLE) AS liquido
FROM ({RECHARGE_SQL})""")
def _(t):
    fee = enc.sos_fee("VALOR_SOS")
    return recharge_rows(t).select(
        "NUM_CPF", F.col("VALOR_SOS").cast("double").alias("VALOR_SOS"), fee.cast("double").alias("taxa"),
        (money("VAL_CREDITO_INSERIDO") - money("VALOR_SOS") - money(fee)).cast("double").alias("liquido"))


@query("enc_allow_list", f"SELECT NUM_CPF, {CARD_SQL} AS cartao, {ORIGIN_SQL} AS origem FROM ({RECHARGE_SQL})")
def _(t):
    return recharge_rows(t).select("NUM_CPF", enc.allow_list("COD_GRUPO_CARTAO", K.TOP_CARDS).alias("cartao"),
                                   enc.allow_list("DSC_GRUPO_CARTAO_WPP", K.TOP_ORIGINS).alias("origem"))


DELAY_DAYS_SQL = """CASE WHEN DAT_CRIACAO_PAGAMENTO NOT IN (DATE '1900-01-01', DATE '9999-12-31')
  AND DAT_VENCIMENTO_CREDITO NOT IN (DATE '1900-01-01', DATE '9999-12-31')
  THEN CAST(DAT_CRIACAO_PAGAMENTO - DAT_VENCIMENTO_CREDITO AS INTEGER) END"""
DELAY_STATUS_SQL = """CASE WHEN DIAS_ATRASO IS NULL THEN 'SEM_STATUS' WHEN DIAS_ATRASO > 0 THEN 'ATRASADO'
  WHEN DIAS_ATRASO = 0 THEN 'EM_DIA' ELSE 'ADIANTADO' END"""
INTEREST_SQL = """CASE WHEN JUROS = 0 THEN 'SEM_JUROS' WHEN JUROS <= 1.10 THEN 'INSIGNIFICANTE' WHEN JUROS <= 5.00 THEN 'MODERADO'
  WHEN JUROS <= 50.00 THEN 'ALTO' ELSE 'MUITO_ALTO' END"""
FORM_SQL = """CASE DW_FORMA_PAGAMENTO WHEN 10 THEN 'ONLINE' WHEN 14 THEN 'ARRECADACAO_BANCARIA' WHEN 12 THEN 'DEBITO_DIRETO'
  WHEN 15 THEN 'ACORDO_PAGAMENTO' ELSE 'OUTROS' END"""
BANK_SQL = f"""CASE WHEN NUM_BANCO_PAGAMENTO = '-3' THEN 'NAO_INFORMADO' WHEN NUM_BANCO_PAGAMENTO = 'NT1' THEN 'NT1'
  WHEN NUM_BANCO_PAGAMENTO IN ({_IN(K.TRADITIONAL_BANKS)}) THEN 'TRADICIONAL'
  WHEN NUM_BANCO_PAGAMENTO IN ({_IN(K.FINTECH_BANKS)}) THEN 'FINTECH' ELSE 'OUTROS' END"""


@query("enc_dpd_status", f"""
SELECT NUM_CPF, DW_NUM_CLIENTE, SEQ_FATURA, DIAS_ATRASO, {DELAY_STATUS_SQL} AS status
FROM (SELECT *, {DELAY_DAYS_SQL} AS DIAS_ATRASO FROM ({PAYMENT_SQL}))""")
def _(t):
    from riskmart.functions.values import null_if_open_date
    df = payment_rows(t).withColumn("DIAS_ATRASO", F.datediff(
        null_if_open_date("DAT_CRIACAO_PAGAMENTO"), null_if_open_date("DAT_VENCIMENTO_CREDITO")))
    return df.select("NUM_CPF", "DW_NUM_CLIENTE", "SEQ_FATURA", "DIAS_ATRASO", enc.delay_status("DIAS_ATRASO").alias("status"))


@query("enc_interest_tiers", f"""
SELECT DW_NUM_CLIENTE, SEQ_FATURA, JUROS, {INTEREST_SQL} AS faixa
FROM (SELECT *, CAST(round(CAST(VAL_JUROS_MULTAS_ITEM AS DECIMAL(28,9)), 2) AS DOUBLE) AS JUROS FROM ({PAYMENT_SQL}))""")
def _(t):
    df = payment_rows(t).withColumn("JUROS", rounded("VAL_JUROS_MULTAS_ITEM"))
    return df.select("DW_NUM_CLIENTE", "SEQ_FATURA", "JUROS", enc.interest_tier("JUROS").alias("faixa"))


@query("enc_code_map", f"SELECT DW_NUM_CLIENTE, SEQ_FATURA, {FORM_SQL} AS forma FROM ({PAYMENT_SQL})")
def _(t):
    return payment_rows(t).select("DW_NUM_CLIENTE", "SEQ_FATURA", enc.code_name("DW_FORMA_PAGAMENTO", K.PAYMENT_FORMS).alias("forma"))


@query("enc_bank_cluster", f"SELECT DW_NUM_CLIENTE, SEQ_FATURA, {BANK_SQL} AS banco FROM ({PAYMENT_SQL})")
def _(t):
    return payment_rows(t).select("DW_NUM_CLIENTE", "SEQ_FATURA", enc.bank_cluster("NUM_BANCO_PAGAMENTO").alias("banco"))


BUCKET_SQL = """CASE DSC_GRUPO_PLATAFORMA WHEN 'Pré Pago' THEN 'PRE_PAGO' WHEN 'Controle' THEN 'CONTROLE'
  WHEN 'Pós Pago' THEN 'POS_PAGO' ELSE 'OUTROS' END"""


@query("enc_platform_bucket", f"SELECT NUM_CPF, {BUCKET_SQL} AS categoria FROM ({RECHARGE_SQL})")
def _(t):
    return recharge_rows(t).select("NUM_CPF", enc.platform_bucket("DSC_GRUPO_PLATAFORMA").alias("categoria"))


@query("enc_majority_label", f"""
SELECT vintage, CASE WHEN avg(CASE WHEN vintage >= 200001 OR flag = 1 THEN 1 ELSE 0 END) > 0.5 THEN 'OOT (Teste)' ELSE 'Treino' END AS base
FROM ({SCORED_SQL}) GROUP BY vintage""")
def _(t):
    df = scored(t).withColumn("f", ((F.col("vintage") >= 200001) | (F.col("flag") == 1)).cast("int"))
    return df.groupBy("vintage").agg(enc.majority_label(F.avg("f")).alias("base"))
