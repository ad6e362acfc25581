"""Raw to base table on hand-made rows, with every dimension."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.plans import abt, books, silver


def text_frame(spark, columns, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))


REG = ["NUM_CPF", "SAFRA", "PROD", "FLAG_INSTALACAO", "FPD", "flag_mig2", "STATUSRF", "DATADENASCIMENTO", "CEP_3_digitos"] + \
      [f"var_{i:02d}" for i in range(2, 26)]


@pytest.fixture(scope="module")
def raw_registration(spark):
    rows = [
        {"NUM_CPF": "11111AA1", "SAFRA": "202502", "PROD": "CMV", "FLAG_INSTALACAO": "1", "FPD": "1", "flag_mig2": "PRE",
         "STATUSRF": "REGULAR", "DATADENASCIMENTO": "10/03/1980", "CEP_3_digitos": "131", "var_02": "5.5", "var_07": "20000000",
         "var_08": "41", "var_11": "1000.5", "var_12": "01/02/2024", "var_14": "6", "var_15": "SP", "var_17": "202301",
         "var_20": "FUNC_PUBL", "var_24": "ADMITIDO", "var_25": "CLT INSS"},
        {"NUM_CPF": "22222ZZ2", "SAFRA": "202502", "PROD": "NET", "FLAG_INSTALACAO": "0"},
        {"NUM_CPF": "33333AA3", "SAFRA": "202502", "PROD": "CMV", "FLAG_INSTALACAO": "1", "FPD": "0", "STATUSRF": "NULA"},
        {"NUM_CPF": "44444AA4", "SAFRA": "202502", "PROD": "CMV", "FLAG_INSTALACAO": "1", "FPD": "0", "DATADENASCIMENTO": "01/01/2015"},
    ]
    df = text_frame(spark, REG, rows)
    return df.withColumns({"SAFRA": F.col("SAFRA").cast("int"), "FPD": F.col("FPD").cast("int"),
                           "FLAG_INSTALACAO": F.col("FLAG_INSTALACAO").cast("int")})


def test_registration_flags_come_from_the_raw_value(spark, raw_registration):
    out = silver.registration(raw_registration)
    assert out.columns == silver.REGISTRATION_ORDER
    empty = out.where("NUM_CPF = '22222ZZ2'").first().asDict()
    assert empty["GRUPO_CONTROLE"] is True and empty["ID_UNICO"] == "22222ZZ2202502"
    for flag in ("var_03_MISSING", "var_05_MISSING", "DATADENASCIMENTO_MISSING", "SALARIO_FUNC_PUBL_MISSING"):
        assert empty[flag] == 1
    assert (empty["var_03"], empty["var_02"], empty["SAFRA_BOLSA_FAMILIA"], empty["CEP_3_digitos"]) == (-1, -999.0, 190001, "XXX")
    assert empty["DATADENASCIMENTO"] == dt.date(1000, 1, 1) and empty["DATA_FUNC_PRIVADO"] == dt.date(9999, 1, 1)
    full = out.where("NUM_CPF = '11111AA1'").first()
    assert (full.FUNC_PUBL, full.SALARIO_FUNC_PUBL, full.VALOR_EMPR_DIRETOR, full.DATADENASCIMENTO_MISSING) == (1, 1000.5, 6.0, 0)


def test_registration_features(spark, raw_registration):
    out = abt.registration_features(silver.registration(raw_registration))
    rows = {r.NUM_CPF: r.asDict() for r in out.collect()}
    assert set(rows) == {"11111AA1", "22222ZZ2"}          # void status and minors are out
    a, b = rows["11111AA1"], rows["22222ZZ2"]
    assert (a["IDADE"], a["IDADE_30_44"], a["STATUSRF_REGULAR"], a["MIG_PRE"], a["NUM_EMPRE_DIRETOR_5_OU_MAIS"]) == (44, 1, 1, 1, 1)
    assert (a["QTD_VINCULOS_RENDA"], a["TEMPO_EMPREGO_MESES"], a["FLG_EMPREGO_CLT_1_A_3_ANOS"]) == (2, 12.0, 1)
    assert (a["var_07_MONETARIO_TRATADA"], a["FLG_ANOMALIA_VAR_07"]) == (9999999.0, 1)
    assert (a["FLG_CEP_REGIAO_13"], a["FLG_CEP_NAO_INFORMADO"], a["UF_BF_SP"], a["SAFRA_BF_2023"]) == (1, 0, 1, 1)
    assert a["FLG_INSS_APOSENTADORIA_PERMANENTE"] == 1 and b["FLG_INSS_OUTROS_BENEFICIOS"] == 0
    assert (b["IDADE"], b["IDADE_AUSENTE"], b["SEM_MIGRACAO"], b["FLG_CEP_NAO_INFORMADO"], b["TEMPO_EMPREGO_MESES"]) == (-4, 1, 1, 1, -1.0)
    found = abt.registration_features(silver.registration(raw_registration), postal_domain=None)
    assert [c for c in found.columns if c.startswith("FLG_CEP_REGIAO_")] == ["FLG_CEP_REGIAO_13"]


DIMS = {
    "tipo_insercao": (["DW_TIPO_INSERCAO", "DSC_TIPO_INSERCAO", "DAT_EXPIRACAO_DW", "DAT_CRIACAO_DW"], [("1", "auto", None, "07MAY2010:11:23:38")]),
    "status_plataforma": (["COD_STATUS_PLATAFORMA", "DSC_STATUS_PLATAFORMA", "IND_ATIVO", "DAT_ATUALIZACAO_DW", "DAT_CRIACAO_DW"],
                          [("A", "ativo", "S", "07MAY2010:11:23:38", None)]),
    "canal_aquisicao_credito": (["COD_CANAL_AQUISICAO", "COD_SISTEMA_DW", "DSC_CANAL_AQUISICAO", "COD_AGENTE_CREDITO", "COD_TIPO_CREDITO",
                                 "COD_TIPO_INSTITUICAO", "DSC_TIPO_INSTITUICAO", "DAT_EXPIRACAO_DW", "DAT_ATUALIZACAO_DW", "DAT_CRIACAO_DW"],
                                [(1, "s", "Itau", None, None, None, None, None, None, None), (-2, "s", "ND", "x", "y", 5, None, None, None, None)]),
    "forma_pagamento": (["DW_FORMA_PAGAMENTO", "COD_FORMA", "DSC_FORMA_PAGAMENTO", "DAT_CRIACAO_DW", "DAT_EXPIRACAO_DW"], [(1, "c", "cartao", None, None)]),
    "instituicao": (["DW_INSTITUICAO", "DSC_INSTITUICAO", "COD_TIPO_INSTITUICAO", "DSC_TIPO_INSTITUICAO", "DAT_CRIACAO_DW", "DAT_EXPIRACAO_DW"],
                    [(1, "i", 2, "BANCO", None, None)]),
    "plataforma": (["DW_PLATAFORMA", "DSC_PLATAFORMA", "DAT_EXPIRACAO_DW", "DAT_ATUALIZACAO_DW", "DAT_CRIACAO_DW", "DSC_PLATAFORMA_BI",
                    "DSC_X", "DSC_GRUPO_PLATAFORMA"], [(1, "P1", None, None, None, "Pré", "x", None)]),
    "tipo_credito": (["COD_TIPO_CREDITO", "DSC_TIPO_CREDITO", "DAT_EXPIRACAO_DW", "DAT_ATUALIZACAO_DW", "DAT_CRIACAO_DW"],
                     [("NAO INFORMADO", "ni", None, None, None)]),
    "tipo_recarga": (["DW_TIPO_RECARGA", "DSC_TIPO_RECARGA", "DAT_EXPIRACAO_DW", "DAT_CRIACAO_DW"], [(1, "Online", None, None)]),
    "tecnologia": (["COD_TECNOLOGIA_DW", "COD_TECNOLOGIA_SVA", "DAT_ATUALIZACAO_DW", "DAT_CRIACAO_DW"],
                   [("-1", None, None, None), ("-2", "z", None, None), ("-3", "z", None, None), ("1", None, None, None)]),
}
INTS = {"COD_CANAL_AQUISICAO", "DW_FORMA_PAGAMENTO", "DW_INSTITUICAO", "COD_TIPO_INSTITUICAO", "DW_PLATAFORMA", "DW_TIPO_RECARGA"}


@pytest.fixture(scope="module")
def dims(spark):
    out = {}
    for name, (columns, rows) in DIMS.items():
        schema = ", ".join(f"{c} {'int' if c in INTS else 'string'}" for c in columns)
        out[name] = silver.dimension(spark.createDataFrame(rows, schema), name)
    plan = ["DW_PLANO", "DSC_PLANO_PRECO", "COD_TIPO_CLIENTE", "COD_SUB_TIPO_CLIENTE", "DSC_PLANO_PRECO_BI", "DSC_TIPO_PLANO_BI"]
    out["plano_preco"] = spark.createDataFrame([(1, "Prezao", "c", "s", "b", "t"), (-4, "-4", "-4", "-4", "-4", "-4")],
                                               "DW_PLANO int, " + ", ".join(f"{c} string" for c in plan[1:]))
    return out


def test_dimension_defaults_and_members(dims):
    rows = {r.COD_TECNOLOGIA_DW: r.COD_TECNOLOGIA_SVA for r in dims["tecnologia"].collect()}
    assert rows == {"-1": "Não se aplica", "-2": "Não definido", "-3": "Não informado", "1": "DESCONHECIDO"}
    assert dims["tecnologia"].first().DAT_ATUALIZACAO_DW == dt.date(2010, 5, 7)
    assert dims["tipo_insercao"].first().DAT_EXPIRACAO_DW == dt.date(9999, 12, 31)
    assert {r.DW_TIPO_RECARGA for r in dims["tipo_recarga"].collect()} == {1, -4}
    assert dims["plataforma"].where("DW_PLATAFORMA = 1").first().DSC_GRUPO_PLATAFORMA == "Outros"
    full = books.complete_dimensions(dims)
    patched = full["canal_aquisicao_credito"].where("COD_CANAL_AQUISICAO = -2").first()
    assert (patched.COD_TIPO_INSTITUICAO, patched.COD_AGENTE_CREDITO, patched.COD_TIPO_CREDITO) == (-2, "NAO DECLARADO", "NAO DECLARADO")
    assert {r.DW_INSTITUICAO for r in full["instituicao"].collect()} == {1, -1, -2}


RECHARGE = {"NUM_CPF": "11111AA1", "DW_NUM_NTC": "55", "DW_NUM_CLIENTE": "9", "DAT_INSERCAO_CREDITO": "15JAN2025:10:00:00",
            "HOR_INSERCAO_CREDITO": "70000", "VAL_CREDITO_INSERIDO": "20.5", "VAL_BONUS": "0", "VAL_REAL": "20.5", "FLAG_SOS": "0",
            "VALOR_SOS": None, "DW_TIPO_RECARGA": "1", "DW_PLANO_TARIFACAO": "1", "COD_PROMOCAO": None, "COD_CANAL_AQUISICAO": "1",
            "DW_TIPO_INSERCAO": "1", "DW_FORMA_PAGAMENTO": "1", "DW_INSTITUICAO": "1", "COD_STATUS_PLATAFORMA": "A",
            "COD_PLATAFORMA_ATU": "P1", "COD_GRUPO_CARTAO": "UB", "DSC_GRUPO_CARTAO_WPP": "-2"}


@pytest.fixture(scope="module")
def recharge_book(spark, dims, raw_registration):
    rows = [RECHARGE, {**RECHARGE, "DAT_INSERCAO_CREDITO": "20OCT2024:00:00:01", "DW_NUM_NTC": "56", "FLAG_SOS": "1", "VALOR_SOS": "3.5",
                       "HOR_INSERCAO_CREDITO": "190000", "DW_PLANO_TARIFACAO": None, "DW_TIPO_RECARGA": None},
            {**RECHARGE, "DAT_INSERCAO_CREDITO": "01FEB2025:00:00:00"}]
    full = books.complete_dimensions(dims)
    facts = books.enrich_recharge(silver.recharge(text_frame(spark, list(RECHARGE), rows)), full)
    return books.recharge_book(silver.registration(raw_registration), facts, books.recharge_domains(full))


def test_recharge_book_through_all_dimensions(recharge_book):
    assert recharge_book.count() == 1
    r = recharge_book.first()
    assert (r.ID_UNICO, r.QTD_RECARGAS_HIST, r.QTD_CELULARES_RECARREGADOS, r.QTD_DIAS_ULTIMA_RECARGA) == ("11111AA1202502", 2, 2, 17)
    assert (r.QTD_RECARGAS_U30D, r.QTD_RECARGAS_U31_90D, r.VAL_TOTAL_CREDITO_HIST) == (1, 0, 41.0)
    # second: 20.5 - 3.5 - fee 2 = 15
    assert (r.VAL_TOTAL_REAL_HIST, r.VAL_TICKET_MEDIO_REAL, r.VAL_TOTAL_TAXA_SOS_PAGA, r.VAL_MEDIA_SOS_TOMADO) == (35.5, 17.75, 2.0, 3.5)
    assert (r.PCT_MOMENTUM_RECARGA_30D, r.PCT_DEPENDENCIA_SOS, r.VAL_MEDIA_DIAS_ENTRE_RECARGAS) == (0.0, 0.0854, 8.5)
    assert (r.QTD_TURNO_MANHA, r.QTD_TURNO_NOITE, r.QTD_CANAL_BANCOS_TRADICIONAL, r.QTD_PLANO_PRE_PAGO_CORE, r.QTD_PLANO_DESCONHECIDO) == (1, 1, 2, 1, 1)
    assert (r.QTD_CARTAO_UB, r.QTD_ORIGEM_NAO_DETERMINADO, r.QTD_PLATAFORMA_PR, r.QTD_TIPO_RECAR_ONLINE, r.QTD_TIPO_RECAR_DESCONHECIDO) == (2, 2, 2, 1, 1)


PAYMENT = {"NUM_CPF": "11111AA1", "DW_NUM_CLIENTE": "c1", "SEQ_FATURA": "1", "DAT_STATUS_FATURA": "10JAN2025:00:00:00",
           "DAT_CRIACAO_PAGAMENTO": "12JAN2025:00:00:00", "DAT_VENCIMENTO_CREDITO": "10JAN2025:00:00:00", "DAT_STATUS_PAGAMENTO": "12JAN2025:00:00:00",
           "VAL_PAGAMENTO_FATURA": "100.10", "VAL_JUROS_MULTAS_ITEM": "1.10", "VAL_PAGAMENTO_ITEM": None, "VAL_BAIXA_ATIVIDADE": None,
           "IND_STATUS_FATURA": "F", "IND_STATUS_PAGAMENTO": None, "DW_FORMA_PAGAMENTO": "12", "DW_TIPO_PAGAMENTO": "B", "NUM_BANCO_PAGAMENTO": "104",
           "COD_ALOCACAO_CREDITO": None, "DW_UN_NEGOCIO": "R1", "SEQ_FATURA_CREDITO": None}


@pytest.fixture(scope="module")
def payments(spark):
    rows = [PAYMENT, {**PAYMENT, "SEQ_FATURA": "4", "DAT_CRIACAO_PAGAMENTO": None, "VAL_JUROS_MULTAS_ITEM": None, "IND_STATUS_PAGAMENTO": "B"},
            {**PAYMENT, "DW_NUM_CLIENTE": "c2", "SEQ_FATURA": "3", "DAT_CRIACAO_PAGAMENTO": "01JAN2025:00:00:00"},
            {**PAYMENT, "DAT_STATUS_FATURA": "01FEB2025:00:00:00", "SEQ_FATURA": "99"}]
    return silver.payment(text_frame(spark, list(PAYMENT), rows))


def test_payment_conform(payments):
    r = payments.where("SEQ_FATURA = '4'").first().asDict()
    assert r["DAT_CRIACAO_PAGAMENTO"] == dt.date(1900, 1, 1) and r["VAL_BAIXA_ATIVIDADE"] == -444444.0
    assert (r["VAL_JUROS_MULTAS_ITEM"], r["COD_ALOCACAO_CREDITO"], r["BLOCO_28-03-percet_MISSING"], r["ANO_FATURA"], r["MES_FATURA"]) == (0.0, "DESCONHECIDO", 1, 2025, 1)


def test_payment_book(payments, raw_registration):
    r = books.payment_book(silver.registration(raw_registration), payments).first()
    assert (r.QTD_TOTAL_FATURAS_PAGAS, r.QTD_MAX_DIAS_ATRASO, r.VAL_TOTAL_PAG_FATURA, r.VAL_TOTAL_JUROS_PAGOS) == (7, 2, 300.3, 2.2)
    assert (r.QTD_PERFIL_ATRASO_ATRASADO, r.QTD_PERFIL_ATRASO_SEM_STATUS, r.QTD_PERFIL_ATRASO_ADIANTADO) == (1, 1, 1)
    assert (r.QTD_FREQ_JUROS_SEM_JUROS, r.QTD_FREQ_JUROS_INSIGNIFICANTE, r.QTD_FORMA_PAG_DEBITO_DIRETO, r.QTD_BANCO_TRADICIONAL) == (1, 2, 3, 3)
    assert (r.QTD_STAT_PAG_DESCONHECIDO, r.QTD_STAT_PAG_B, r.QTD_ALOC_DESCONHECIDO, r.FLG_REGIONAL_R1) == (2, 1, 3, 1)


def test_payment_baseline_single_invoice_has_no_spread(payments, raw_registration):
    r = books.payment_book_baseline(silver.registration(raw_registration), payments.where("DW_NUM_CLIENTE = 'c2'")).first()
    assert (r.PAG_QTD_FATURAS_HIST, r.PAG_DESVIO_PADRAO_ATRASO, r.PAG_MAX_DIAS_ATRASO_HIST, r.PAG_DIAS_DESDE_ULTIMO_PAG) == (1, 0.0, 2, 20)


@pytest.fixture(scope="module")
def inputs(spark, raw_registration, recharge_book, payments):
    reg = silver.registration(raw_registration)
    score = silver.score(spark.createDataFrame(
        [("11111AA1", 202502, 1, "CMV", 1, None, 500, None), ("99999AA9", 202501, 1, "CMV", 0, "FLEX", 300, 200)],
        "NUM_CPF string, SAFRA int, FLAG_INSTALACAO int, PROD string, FPD int, flag_mig2 string, SCORE_01 int, SCORE_02 int"))
    telco = silver.telco(spark.createDataFrame(
        [("99999AA9", 202501, "CMV", 0, None, *[None if v != "var_90" else 20000.0 for v in silver.TELCO_VARS])],
        "NUM_CPF string, SAFRA int, PROD string, FPD int, flag_mig2 string, " + ", ".join(f"{v} double" for v in silver.TELCO_VARS)))
    return {"score_bureau_full": score, "telco": telco, "cadastral": reg}, recharge_book, books.payment_book(reg, payments)


def test_stored_stages_give_the_same_tables(spark, inputs, tmp_path):
    lazy, kept = abt.build(*inputs), abt.build_stored(*inputs, str(tmp_path))
    assert set(lazy) == set(kept)
    for name, df in lazy.items():
        assert kept[name].columns == df.columns and kept[name].dtypes == df.dtypes
        assert kept[name].exceptAll(df).count() == 0 and df.exceptAll(kept[name]).count() == 0
    from riskmart.sources.readers import read_folder
    assert read_folder(spark, str(tmp_path / "plus_pagamento")).count() == lazy["plus_pagamento"].count()


def test_books_meet_a_stored_base_without_a_shuffle(spark, tmp_path):
    from riskmart.sources import writers
    base = spark.range(500).select(F.col("id").cast("string").alias("ID_UNICO"), F.lit(1).alias("x"))
    book = spark.range(0, 500, 3).select(F.col("id").cast("string").alias("ID_UNICO"), F.lit("a").alias("NUM_CPF"), F.lit(1).alias("SAFRA"),
                                         F.col("id").alias("QTD_RECARGAS_HIST"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = [writers.store_bucketed(df, str(tmp_path / n)) for n, df in (("base", base), ("book", book))]
        joined = abt.with_recharge(*stored)
        again = writers.store_bucketed(joined, str(tmp_path / "next"), placed=True)
        third = abt.with_book(again, stored[1].withColumnRenamed("QTD_RECARGAS_HIST", "VAL"), "VAL", "SEM")
        for df in (joined, third):
            assert "SortMergeJoin" in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan
        assert len(list((tmp_path / "next").glob("part-*"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert again.where("SEM_HISTORICO_RECARGA = 0").count() == third.where("SEM = 0").count() == 167 and third.count() == 500
        assert writers.store_bucketed(base.limit(3), str(tmp_path / "base")).count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_all_steps(inputs):
    steps = abt.build(*inputs)
    assert {n: df.count() for n, df in steps.items()} == {
        "score_01": 2, "score_02": 2, "plus_telco": 2, "plus_cadastral": 1, "plus_recarga": 1, "plus_pagamento": 1, "nao_contratou": 1}
    t = {r.NUM_CPF: r for r in steps["plus_telco"].collect()}
    a, b = t["11111AA1"], t["99999AA9"]
    assert (a.SEM_TELCO, float(a.var_26), a.CMV, a.var26_a_var77_MISSING, a.SCORE_02, a.DELTA_SCORE, a.Flag_OOT) == (1, -1.0, 0, 0, -4, -9999, 1)
    assert (b.SEM_TELCO, float(b.var_26), float(b.var_90), b.anomalia_var_90, b.var26_a_var77_MISSING, b.DELTA_SCORE) == (0, -4.0, -4.0, 1, 1, 100)
    final = steps["plus_pagamento"].first()
    assert (final.SEM_HISTORICO_RECARGA, final.SEM_HISTORICO_POS_PAGO, final.SEM_SCORE_E_TELCO, final.QTD_RECARGAS_HIST) == (0, 0, 0, 2)
    lost = steps["nao_contratou"].first()
    assert (lost.SEM_HISTORICO_RECARGA, lost.QTD_RECARGAS_HIST, lost.SEM_SCORE_E_TELCO, lost.DELTA_SCORE, lost.SCORE_01) == (1, -1, 1, -9999, -1)
    columns = [set(steps[K.STEPS[i][1]].columns) for i in (4, 5, 6)]
    assert columns[1] < columns[2] and columns[0] < columns[1]


def test_unknown_raw_table_is_an_error(spark):
    with pytest.raises(ValueError, match="zz"):
        silver.silver({"zz": spark.range(1)})


def test_restricting_to_the_population_changes_nothing_else(payments, raw_registration):
    reg = silver.registration(raw_registration)
    strangers = payments.withColumn("NUM_CPF", F.lit("00000AA0"))
    domains = {"STAT_FAT": ["F"], "TIPO_PAG": ["B"], "STAT_PAG": ["B", "DESCONHECIDO"], "REGIONAL": ["R1"]}
    both = [books.payment_book(reg, payments.unionByName(strangers), domains, restrict=r).collect() for r in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 1


def test_latest_cutoff_prunes_years_without_changing_the_book(spark, payments, raw_registration, tmp_path):
    from riskmart.sources import writers
    extra = payments.withColumns({"DAT_STATUS_FATURA": F.lit("2026-05-01").cast("date"), "ANO_FATURA": F.lit(2026)})
    writers.write_parquet(payments.unionByName(extra), str(tmp_path / "p"), ["ANO_FATURA", "MES_FATURA"])
    stored = spark.read.parquet(str(tmp_path / "p"))
    reg = silver.registration(raw_registration)
    domains = {"STAT_FAT": ["F"], "TIPO_PAG": ["B"], "STAT_PAG": ["B", "DESCONHECIDO"], "REGIONAL": ["R1"]}
    early = books.payment_book(reg, stored, domains, until="2025-02-01")
    assert early.collect() == books.payment_book(reg, payments, domains).collect()
    plan = early._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ANO_FATURA" in plan
