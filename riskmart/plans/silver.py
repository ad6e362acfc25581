"""Raw tables to conformed tables: typed values, missing flags, sentinels, unknown members."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart import constants as K
from riskmart.functions.dates import parse_day, part_columns
from riskmart.functions.text import control_flag, key_of
from riskmart.functions.values import missing_flag, presence_flag, typed_or
from riskmart.operators.frames import patch_by_key, project, with_members

# --- fixed values: column plans ----------------------------------------------

# output: (raw column, type, sentinel)
REGISTRATION_VALUES = {
    "SALARIO_FUNC_PUBL": ("var_11", "double", -1.0),
    "CARGO_FUNC_PUBL": ("var_10", "string", "NAO_APLICAVEL"),
    "var_02": ("var_02", "double", K.RAW_NULL),
    "VALOR_EMPR_DIRETOR": ("var_14", "float", K.RAW_NULL),
    "SAFRA_BOLSA_FAMILIA": ("var_17", "int", K.BENEFIT_VINTAGE_NULL),
    "UF_BOLSA_FAMILIA": ("var_15", "string", "NAO_APLICAVEL"),
    "BENEFICIO_BOLSA_FAMILIA": ("var_16", "float", 0),
    "var_07_MONETARIO": ("var_07", "float", K.RAW_NULL),
    "NUMERO_APOSENTADO": ("var_08", "int", K.RAW_NULL),
    "MESES_AUXILIO_EMERGENCIAL": ("var_09", "int", 0),
    "STATUS_FUNC_PRIVADO": ("var_24", "string", "NAO_APLICAVEL"),
    "flag_mig2": ("flag_mig2", "string", "SEM_MIGRACAO"),
    "CONSOLIDADO": ("var_25", "string", "SEM_INFORMACAO"),
    "CEP_3_digitos": ("CEP_3_digitos", "string", "XXX"),
    "var_03": ("var_03", "int", -1),
    "var_05": ("var_05", "int", -1),
    "STATUSRF": ("STATUSRF", "string", "SEM_STATUS"),
    "NUM_STATUSRF": ("var_04", "int", -1),
}
REGISTRATION_DATES = {
    "DATA_FUNC_PRIVADO": ("var_12", K.JOB_DATE_NULL),
    "DATADENASCIMENTO": ("DATADENASCIMENTO", K.BIRTH_DATE_NULL),
}
# flag: raw column it watches
REGISTRATION_MISSING = {
    "SALARIO_FUNC_PUBL_MISSING": "var_11", "var_02_missing": "var_02", "VALOR_EMPR_DIRETOR_MISSING": "var_14",
    "SAFRA_BOLSA_FAMILIA_MISSING": "var_17", "BENEFICIO_BOLSA_FAMILIA_MISSING": "var_16",
    "var_07_MONETARIO_MISSING": "var_07", "NUMERO_APOSENTADO_MISSING": "var_08",
    "MESES_AUXILIO_EMERGENCIAL_MISSING": "var_09", "DATA_FUNC_PRIVADO_MISSING": "var_12",
    "var_03_MISSING": "var_03", "var_05_MISSING": "var_05", "DATADENASCIMENTO_MISSING": "DATADENASCIMENTO",
}
# flag: (raw column, required value or None for "present")
REGISTRATION_PRESENCE = {
    "FUNC_PUBL": ("var_20", "FUNC_PUBL"), "EMPR_DIRETOR": ("var_22", None), "BOLSA_FAMILIA": ("var_23", None),
    "APOSENTADO": ("var_18", None), "AUXILLIO_EMERGENCIAL": ("var_19", None), "FUNC_PRIVADO": ("var_21", None),
}
REGISTRATION_ORDER = [
    "ID_UNICO", "GRUPO_CONTROLE", "NUM_CPF", "SAFRA", "PROD", "FLAG_INSTALACAO", "flag_mig2", "FPD",
    "STATUSRF", "NUM_STATUSRF", "DATADENASCIMENTO", "DATADENASCIMENTO_MISSING",
    "FUNC_PUBL", "CARGO_FUNC_PUBL", "SALARIO_FUNC_PUBL", "SALARIO_FUNC_PUBL_MISSING",
    "EMPR_DIRETOR", "VALOR_EMPR_DIRETOR", "VALOR_EMPR_DIRETOR_MISSING",
    "BOLSA_FAMILIA", "SAFRA_BOLSA_FAMILIA", "SAFRA_BOLSA_FAMILIA_MISSING", "UF_BOLSA_FAMILIA",
    "BENEFICIO_BOLSA_FAMILIA", "BENEFICIO_BOLSA_FAMILIA_MISSING",
    "APOSENTADO", "NUMERO_APOSENTADO", "NUMERO_APOSENTADO_MISSING",
    "AUXILLIO_EMERGENCIAL", "MESES_AUXILIO_EMERGENCIAL", "MESES_AUXILIO_EMERGENCIAL_MISSING",
    "FUNC_PRIVADO", "STATUS_FUNC_PRIVADO", "DATA_FUNC_PRIVADO", "DATA_FUNC_PRIVADO_MISSING",
    "CONSOLIDADO", "CEP_3_digitos", "var_07_MONETARIO", "var_07_MONETARIO_MISSING",
    "var_02", "var_02_missing", "var_03", "var_03_MISSING", "var_05", "var_05_MISSING",
]
SCORE_ORDER = ["ID_UNICO", "GRUPO_CONTROLE", "NUM_CPF", "SAFRA", "FLAG_INSTALACAO", "PROD", "FPD", "flag_mig2",
               "SCORE_01", "SCORE_01_MISSING", "SCORE_02", "SCORE_02_MISSING"]
TELCO_VARS = [f"var_{i}" for i in range(26, 94)]

PAYMENT_TEXTS = [
    "COD_NETUNO_PAGAMENTO", "COD_DESALOCACAO_CREDITO", "DSC_PAGAMENTO", "COD_ARQUIVO_PAGAMENTO",
    "COD_BANCO_ATIVIDADE", "COD_ORIGEM_NETUNO", "COD_RAZAO_ATIVIDADE", "NUM_FATURA_PAGAMENTO", "IND_TIPO_CREDITO",
    "DSC_NOME_BANCO_PAGAMENTO", "COD_TIPO_PAGAMENTO", "COD_FORMA_PAGAMENTO", "COD_TIPO_FATURA",
    "COD_ALOCACAO_CREDITO", "COD_CONTA_ATIVIDADE", "COD_ATIVIDADE", "DAT_ATUALIZACAO_CREDITO",
]
PAYMENT_CODE_TEXTS = ["NUM_CONTA_ATIVIDADE", "COD_AGENCIA_ATIVIDADE", "IND_STATUS_PAGAMENTO"]
PAYMENT_INTS = [
    "COD_FUNDO_ATIVIDADE", "NUM_PARCELA_PAGAMENTO", "COD_METODO_PAGAMENTO", "NUM_AGRUPADOR_PAGAMENTO",
    "COD_LOGIN_PAGAMENTO", "COD_LOGIN_CREDITO", "COD_LOGIN_OPERADOR_ATIVIDADE", "SEQ_ARQUIVO_PAGAMENTO",
    "SEQ_FATURA_CREDITO", "SEQ_PAGAMENTO_CREDITO", "SEQ_ENTIDADE_PAGAMENTO", "SEQ_ENTIDADE_ATIVIDADE",
    "SEQ_ENTIDADE_CREDITO",
]
PAYMENT_AMOUNTS = {
    "VAL_ATUAL_PAGAMENTO": -4.0, "VAL_PAGAMENTO_CREDITO": -4.0, "VAL_ORIGINAL_PAGAMENTO": -4.0,
    "VAL_BAIXA_ATIVIDADE": K.WRITE_OFF_NULL, "VAL_DESCONTO_ITEM": 0.0, "VAL_PAGAMENTO_ITEM": 0.0,
    "VAL_JUROS_MULTAS_ITEM": 0.0, "VAL_MULTA_EQUIP_ITEM": 0.0, "VAL_MULTA_EQUIP_TOTAL": 0.0, "VAL_MULTA_FID_ITEM": 0.0,
}
PAYMENT_DATES = {
    "DAT_ATUALIZACAO_ATIVIDADE": K.OPEN_START, "DAT_ATUALIZACAO_PAGAMENTO": K.OPEN_START,
    "DAT_STATUS_PAGAMENTO": K.OPEN_START, "DAT_CRIACAO_CREDITO": K.OPEN_START, "DAT_CRIACAO_PAGAMENTO": K.OPEN_START,
    "DAT_ATIVIDADE_CREDITO": K.OPEN_START, "DAT_CRIACAO_ATIVIDADE": K.OPEN_START, "DAT_BAIXA_ATIVIDADE": K.OPEN_END,
    "DAT_DEPOSITO_ATIVIDADE": K.OPEN_END, "DAT_VENCIMENTO_CREDITO": K.OPEN_END, "DAT_STATUS_FATURA": None,
    "DAT_CRIACAO_DW": None,
}
PAYMENT_MISSING = {
    "COD_FUNDO_ATIVIDADE_MISSING": "COD_FUNDO_ATIVIDADE", "NUM_PARCELA_PAGAMENTO_MISSING": "NUM_PARCELA_PAGAMENTO",
    "DAT_ATUALIZACAO_ATIVIDADE_MISSING": "DAT_ATUALIZACAO_ATIVIDADE",
    "DAT_ATUALIZACAO_PAGAMENTO_MISSING": "DAT_ATUALIZACAO_PAGAMENTO", "NUM_AGRUPADOR_MISSING": "NUM_AGRUPADOR_PAGAMENTO",
    "COD_LOGIN_PAGAMENTO_MISSING": "COD_LOGIN_PAGAMENTO", "COD_LOGIN_CREDITO_MISSING": "COD_LOGIN_CREDITO",
    "COD_LOGIN_OPERADOR_ATIVIDADE_MISSING": "COD_LOGIN_OPERADOR_ATIVIDADE",
    "SEQ_ARQUIVO_PAGAMENTO_MISSING": "SEQ_ARQUIVO_PAGAMENTO", "VAL_ATUAL_PAGAMENTO_MISSING": "VAL_ATUAL_PAGAMENTO",
    "BLOCO_28-03-percet_MISSING": "SEQ_FATURA_CREDITO",
}

# dimension: date columns with their default, fills, and appended members (in column order)
DIMENSIONS: dict[str, dict] = {
    "tipo_insercao": {"dates": {"DAT_CRIACAO_DW": None, "DAT_EXPIRACAO_DW": K.OPEN_END}},
    "promocao_credito": {
        "dates": {"DAT_EXPIRACAO_DW": K.OPEN_END, "DAT_ATUALIZACAO_DW": None, "DAT_CRIACAO_DW": None,
                  "DAT_INICIO_VIGENCIA": None, "DAT_FIM_VIGENCIA": None},
        "members": [
            (-1, "Não se aplica", K.OPEN_END, K.OPEN_START, K.OPEN_START, -1, "Não se aplica", "Não se aplica",
             K.OPEN_START, K.OPEN_END, -1.0, -1),
            (-4, "DESCONHECIDO", K.OPEN_END, K.OPEN_START, K.OPEN_START, -4, "DESCONHECIDO", "DESCONHECIDO",
             K.OPEN_START, K.OPEN_END, -4.0, -4)]},
    "canal_aquisicao_credito": {
        "dates": {"DAT_EXPIRACAO_DW": K.OPEN_END, "DAT_ATUALIZACAO_DW": None, "DAT_CRIACAO_DW": None},
        "fills": {"COD_TIPO_CREDITO": "NAO INFORMADO", "COD_AGENTE_CREDITO": "NAO INFORMADO",
                  "COD_TIPO_INSTITUICAO": -4, "DSC_TIPO_INSTITUICAO": "DESCONHECIDO"}},
    "status_plataforma": {"dates": {"DAT_ATUALIZACAO_DW": None, "DAT_CRIACAO_DW": None}},
    "tipo_recarga": {"dates": {"DAT_EXPIRACAO_DW": K.OPEN_END, "DAT_CRIACAO_DW": None},
                     "members": [(-4, "DESCONHECIDO", K.OPEN_END, K.OPEN_START)]},
    "plano_preco": {
        "dates": {"DAT_EXPIRACAO_DW": K.OPEN_END, "DAT_EFETIVACAO": K.OPEN_START, "DAT_EXPIRACAO": K.OPEN_END,
                  "DAT_ATUALIZACAO_DW": None, "DAT_CRIACAO_DW": None},
        "ints": ["NUM_FRANQUIA_VOLUME_BI", "NUM_FRANQUIA_REAIS_BI", "NUM_FRANQUIA_EVENTOS_BI",
                 "NUM_FRANQUIA_MINUTOS_BI"],
        "fills": {"DSC_PLANO_PRECO_UNICO_BI": "-4", "COD_PLANO_COMPONENTE": -4,
                  "DSC_MODALIDADE_PLANO": "DESCONHECIDO"},
        "members": [(-4, "-4", "-4", "-4", "-4", 4, K.OPEN_START, K.OPEN_END, "-4", "-4", "-4", "DESC", "-4", -4,
                     "-4", K.OPEN_END, K.OPEN_START, K.OPEN_START, -4, -4, -4, -4, -4, "-4", "DESCONHECIDO")]},
    "forma_pagamento": {"dates": {"DAT_CRIACAO_DW": None, "DAT_EXPIRACAO_DW": K.OPEN_END},
                        "members": [(-4, "-4", "DESCONHECIDO", K.OPEN_START, K.OPEN_END)]},
    "instituicao": {"dates": {"DAT_CRIACAO_DW": None, "DAT_EXPIRACAO_DW": K.OPEN_END}},
    "plataforma": {
        "dates": {"DAT_EXPIRACAO_DW": K.OPEN_END, "DAT_ATUALIZACAO_DW": None, "DAT_CRIACAO_DW": None},
        "fills": {"DSC_GRUPO_PLATAFORMA": "Outros"},
        "members": [(-4, "-4", K.OPEN_END, K.OPEN_START, K.OPEN_START, "DESCONHECIDO", "DESCONHECIDO", "Outros")]},
    "tecnologia": {
        "dates": {"DAT_ATUALIZACAO_DW": "2010-05-07", "DAT_CRIACAO_DW": None},
        "patches": ("COD_TECNOLOGIA_DW", {"COD_TECNOLOGIA_SVA": {
            "-1": "Não se aplica", "-2": "Não definido", "-3": "Não informado"}}),
        "fills": {"COD_TECNOLOGIA_SVA": "DESCONHECIDO"}},
    "tipo_credito": {
        "dates": {"DAT_ATUALIZACAO_DW": "2011-10-19", "DAT_CRIACAO_DW": None, "DAT_EXPIRACAO_DW": K.OPEN_END},
        "members": [("-4", "DESC", K.OPEN_END, K.OPEN_START, K.OPEN_START)]},
}


# --- operators ---------------------------------------------------------------

def with_keys(df: DataFrame) -> DataFrame:
    """Unique key and control-group flag."""
    return df.withColumns({K.ID: key_of(K.CUSTOMER, K.VINTAGE),
                           K.CONTROL: control_flag(K.CUSTOMER, K.CONTROL_MARKS)})


def _date(df: DataFrame, name: str, mask: str, default: str | None):
    """Parse text; a column that already is a date or timestamp only takes the default."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_day(name, mask, default)
    day = F.col(name).cast("date")
    return day if default is None else F.coalesce(day, F.lit(default).cast("date"))


def registration(raw: DataFrame) -> DataFrame:
    """Registration table: every flag is taken from the raw column, before the fill."""
    df = with_keys(raw)
    made = {n: missing_flag(c) for n, c in REGISTRATION_MISSING.items()}
    made |= {n: presence_flag(c, v) for n, (c, v) in REGISTRATION_PRESENCE.items()}
    made |= {n: typed_or(c, t, s) for n, (c, t, s) in REGISTRATION_VALUES.items()}
    made |= {n: _date(df, c, K.DAY_MASK, d) for n, (c, d) in REGISTRATION_DATES.items()}
    return project(df.withColumns(made), REGISTRATION_ORDER)


def telco(raw: DataFrame) -> DataFrame:
    df = with_keys(raw)
    return df.withColumns({
        "flag_mig2": typed_or("flag_mig2", "string", "SEM_MIGRACAO"),
        "var26_a_var77_MISSING": missing_flag("var_26"),
        **{v: typed_or(v, "decimal(18,2)", K.RAW_NULL) for v in TELCO_VARS},
    })


def score(raw: DataFrame) -> DataFrame:
    df = with_keys(raw).withColumns({
        "SCORE_01_MISSING": missing_flag("SCORE_01"), "SCORE_01": typed_or("SCORE_01", "int", -1),
        "SCORE_02_MISSING": missing_flag("SCORE_02"), "SCORE_02": typed_or("SCORE_02", "int", -1)})
    return project(df, SCORE_ORDER)


def dimension(raw: DataFrame, name: str) -> DataFrame:
    """One lookup table, by its entry in ``DIMENSIONS``."""
    plan = DIMENSIONS[name]
    df = raw.withColumns({c: _date(raw, c, K.STAMP_MASK, d) for c, d in plan["dates"].items()})
    if "ints" in plan:
        df = df.withColumns({c: typed_or(c, "int", K.UNKNOWN) for c in plan["ints"]})
    if "patches" in plan:
        key, patches = plan["patches"]
        df = patch_by_key(df.withColumn(key, F.col(key).cast("string")), key, patches)
    if "fills" in plan:
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in plan["fills"].items()})
    if "members" in plan:
        df = with_members(df, [_as_row(df, row) for row in plan["members"]])
    return df


def _as_row(df: DataFrame, values: tuple) -> tuple:
    """Literal member in the types of the dimension's columns."""
    if len(values) != len(df.columns):
        raise ValueError(f"member has {len(values)} values for {len(df.columns)} columns")
    out = []
    for f, v in zip(df.schema, values):
        if isinstance(f.dataType, T.DateType):
            v = date.fromisoformat(v)
        elif isinstance(f.dataType, T.StringType):
            v = str(v)
        elif isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType):
            v = float(v)
        out.append(v)
    return tuple(out)


def recharge(raw: DataFrame) -> DataFrame:
    df = with_control(raw)
    ints = ["COD_CANAL_AQUISICAO", "HOR_INSERCAO_CREDITO", "DW_TIPO_INSERCAO", "DW_FORMA_PAGAMENTO",
            "DW_INSTITUICAO", "FLAG_SOS"]
    made = {
        "VALOR_SOS": typed_or("VALOR_SOS", "float", 0),
        **{c: typed_or(c, "int", K.UNKNOWN) for c in ("DW_TIPO_RECARGA", "DW_PLANO_TARIFACAO", "COD_PROMOCAO")},
        "DAT_INSERCAO_CREDITO": _date(df, "DAT_INSERCAO_CREDITO", K.STAMP_MASK, None),
        **{c: F.col(c).try_cast("bigint") for c in ("DW_NUM_NTC", "DW_NUM_CLIENTE")},
        **{c: F.col(c).try_cast("int") for c in ints},
        **{c: F.col(c).try_cast("float") for c in ("VAL_CREDITO_INSERIDO", "VAL_BONUS", "VAL_REAL")},
    }
    return df.withColumns(made).withColumns(part_columns("DAT_INSERCAO_CREDITO", "ANO_INSERCAO", "MES_INSERCAO"))


def with_control(df: DataFrame) -> DataFrame:
    return df.withColumn(K.CONTROL, control_flag(K.CUSTOMER, K.CONTROL_MARKS))


def payment(raw: DataFrame) -> DataFrame:
    """Payment table; columns a source does not deliver are left out."""
    df = with_control(raw)
    have = set(df.columns)
    made = {n: missing_flag(c) for n, c in PAYMENT_MISSING.items() if c in have}
    made |= {c: typed_or(c, "string", K.UNKNOWN_TEXT) for c in PAYMENT_TEXTS if c in have}
    made |= {c: typed_or(c, "string", "-4") for c in PAYMENT_CODE_TEXTS if c in have}
    made |= {c: typed_or(c, "int", K.UNKNOWN) for c in PAYMENT_INTS if c in have}
    made |= {c: typed_or(c, "float", s) for c, s in PAYMENT_AMOUNTS.items() if c in have}
    made |= {c: _date(df, c, K.STAMP_MASK, d) for c, d in PAYMENT_DATES.items() if c in have}
    return df.withColumns(made).withColumns(part_columns("DAT_STATUS_FATURA", "ANO_FATURA", "MES_FATURA"))


def silver(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Conform every delivered raw table; unknown names are an error."""
    makers = {"cadastral": registration, "telco": telco, "score_bureau_full": score, "recarga": recharge,
              "pagamento": payment}
    out = {}
    for name, df in raw.items():
        if name in makers:
            out[name] = makers[name](df)
        elif name.removeprefix("bi_dim_") in DIMENSIONS:
            out[name] = dimension(df, name.removeprefix("bi_dim_"))
        else:
            raise ValueError(f"no conform plan for table {name}")
    return out
