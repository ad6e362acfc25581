"""Projections, typed conformance, recodes, filters and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.catalogue import plain, plain_sql, query
from riskmart.catalogue.roles import (RAW_REGISTRATION_SQL, RAW_SCORE_SQL, WEEKLY_SPINE, raw_registration,
                                      raw_score, weekly_spine)
from riskmart.functions import dates, text, values
from riskmart.operators import frames, splits
from riskmart.plans import silver

K_OF_PROPS = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _events(t):
    return t.events.withColumn("k", F.get_json_object("props", "$.k"))


# --- keys --------------------------------------------------------------------

@query("spine_vintages", f"SELECT ID_UNICO, NUM_CPF, SAFRA, CUT AS DATA_CORTE_SAFRA FROM ({WEEKLY_SPINE})")
def _(t):
    return weekly_spine(t)


@query("spine_control_flag", f"""
SELECT NUM_CPF, SAFRA, NUM_CPF || CAST(SAFRA AS VARCHAR) AS ID_UNICO,
       substr(NUM_CPF, 6, 2) IN ('ZZ', 'ZX') AS GRUPO_CONTROLE,
       CAST(substr(NUM_CPF, 6, 2) IN ('ZZ', 'ZX') AS INTEGER) AS controle
FROM ({RAW_SCORE_SQL})""")
def _(t):
    return silver.with_keys(raw_score(t)).select(
        K.CUSTOMER, K.VINTAGE, K.ID, K.CONTROL, F.col(K.CONTROL).cast("int").alias("controle"))


# --- typed values ------------------------------------------------------------

@query("conform_typed_coalesce", f"""
SELECT event_id, coalesce(TRY_CAST(nullif(k, '7') AS INTEGER), -4) AS code,
       coalesce(TRY_CAST(CASE WHEN event_type = 'view' THEN 'x' || k ELSE k END AS DOUBLE), -999.0) AS number,
       coalesce(nullif(event_type, 'error'), 'DESCONHECIDO') AS kind,
       coalesce(CASE WHEN event_type <> 'click' THEN CAST(ts AS DATE) END, DATE '1900-01-01') AS day
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""")
def _(t):
    e = _events(t)
    return e.select(
        "event_id", values.typed_or(F.nullif(F.col("k"), F.lit("7")), "int", K.UNKNOWN).alias("code"),
        values.typed_or(F.when(F.col("event_type") == "view", F.concat(F.lit("x"), "k")).otherwise(F.col("k")),
                        "double", -999.0).alias("number"),
        values.typed_or(F.nullif(F.col("event_type"), F.lit("error")), "string", K.UNKNOWN_TEXT).alias("kind"),
        values.typed_or(F.when(F.col("event_type") != "click", F.to_date("ts")), "date", K.OPEN_START).alias("day"))


@query("conform_missing_flags", f"""
SELECT NUM_CPF, SAFRA, CAST(var_11 IS NULL AS INTEGER) AS salario_missing,
       CAST(var_03 IS NULL AS INTEGER) AS var_03_missing, coalesce(CAST(var_03 AS INTEGER), -1) AS var_03
FROM ({RAW_REGISTRATION_SQL})""")
def _(t):
    return raw_registration(t).select(
        "NUM_CPF", "SAFRA", values.missing_flag("var_11").alias("salario_missing"),
        values.missing_flag("var_03").alias("var_03_missing"), values.typed_or("var_03", "int", -1).alias("var_03"))


@query("conform_presence_flags", f"""
SELECT NUM_CPF, SAFRA, CASE WHEN var_20 = 'FUNC_PUBL' THEN 1 ELSE 0 END AS FUNC_PUBL,
       CAST(var_22 IS NOT NULL AS INTEGER) AS EMPR_DIRETOR, CAST(var_23 IS NOT NULL AS INTEGER) AS BOLSA_FAMILIA,
       CAST(var_18 IS NOT NULL AS INTEGER) AS APOSENTADO
FROM ({RAW_REGISTRATION_SQL})""")
def _(t):
    flags = {n: silver.REGISTRATION_PRESENCE[n] for n in ("FUNC_PUBL", "EMPR_DIRETOR", "BOLSA_FAMILIA", "APOSENTADO")}
    return raw_registration(t).select(
        "NUM_CPF", "SAFRA", *[values.presence_flag(c, v).alias(n) for n, (c, v) in flags.items()])


@query("conform_recode", """
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN -4 ELSE l_linenumber END AS seq,
       CASE WHEN l_discount = 0 THEN -999.0 WHEN l_discount = 0.1 THEN -1.0 ELSE l_discount END AS rate
FROM lineitem""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_linenumber").alias("seq"),
                           F.col("l_discount").alias("rate"))
    df = frames.recode_columns(df, ["seq"], {7: K.UNKNOWN})
    return frames.recode_columns(df, ["rate"], {0.0: -999.0, 0.1: -1.0})


@query("conform_null_sentinel_dates", """
WITH d AS (SELECT l_orderkey, l_partkey, l_linenumber,
   CASE WHEN l_linenumber = 7 THEN DATE '1900-01-01' WHEN l_linenumber = 6 THEN DATE '9999-12-31'
        ELSE CAST(l_shipdate AS DATE) END AS day FROM lineitem)
SELECT * REPLACE (CAST(day AS VARCHAR) AS day), CASE WHEN day NOT IN (DATE '1900-01-01', DATE '9999-12-31') THEN day END AS clean FROM d""")
def _(t):
    day = (F.when(F.col("l_linenumber") == 7, F.lit(K.OPEN_START).cast("date"))
           .when(F.col("l_linenumber") == 6, F.lit(K.OPEN_END).cast("date")).otherwise(F.to_date("l_shipdate")))
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", day.alias("day"))
    return plain(df.withColumn("clean", values.null_if_open_date("day")), ("day",))


@query("conform_round_money", """
SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(round(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(28,9)), 2) AS DOUBLE) AS net,
       CAST(round(CAST(l_extendedprice * l_tax AS DECIMAL(28,9)), 2) AS DOUBLE) AS tax
FROM lineitem""")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        values.rounded(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        values.rounded(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"))


@query("conform_cap_anomaly", """
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 300000.0 ELSE o_totalprice END AS capped,
       CAST(o_totalprice > 300000 AS INTEGER) AS anomaly,
       CASE WHEN o_totalprice > 400000 THEN -4.0 ELSE o_totalprice END AS recoded
FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey", values.capped("o_totalprice", 300000.0).alias("capped"),
        values.anomaly_flag("o_totalprice", 300000.0).alias("anomaly"),
        F.when(F.col("o_totalprice") > 400000, F.lit(-4.0)).otherwise(F.col("o_totalprice")).alias("recoded"))


@query("conform_floor_negative", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS floored,
       CASE WHEN c_acctbal < 0 AND c_nationkey <> 1 THEN 0.0 ELSE c_acctbal END AS guarded
FROM customer""")
def _(t):
    return t.customer.select(
        "c_custkey", values.floor_at_zero("c_acctbal").alias("floored"),
        values.floor_at_zero("c_acctbal", F.col("c_nationkey") != 1).alias("guarded"))


@query("conform_delta_guard", f"""
SELECT NUM_CPF, SAFRA, CASE WHEN SCORE_01 >= 0 AND SCORE_02 >= 0 THEN SCORE_01 - SCORE_02 ELSE -9999 END AS DELTA_SCORE
FROM ({RAW_SCORE_SQL})""")
def _(t):
    return raw_score(t).select("NUM_CPF", "SAFRA", values.guarded_delta("SCORE_01", "SCORE_02").alias("DELTA_SCORE"))


@query("conform_text_to_number", """
SELECT event_id, TRY_CAST(CASE WHEN event_type = 'view' THEN 'n/a' ELSE k END AS DOUBLE) AS k, value
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""")
def _(t):
    df = _events(t).select("event_id", F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("k")).alias("k"), "value")
    return frames.texts_to_number(df)


@query("conform_decimal_to_double", """
SELECT l_orderkey, l_partkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price
FROM lineitem""")
def _(t):
    return frames.decimals_to_double(t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", values.money("l_extendedprice").alias("price")))


@query("conform_bulk_cast", """
SELECT event_id, coalesce(TRY_CAST(k AS INTEGER), -4) AS k, coalesce(CAST(user_id AS INTEGER), -4) AS user_id,
       CAST(value AS DOUBLE) AS value
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""")
def _(t):
    df = frames.cast_group(_events(t).select("event_id", "k", "user_id", "value"), {"int": ["k", "user_id"]}, K.UNKNOWN)
    return frames.cast_group(df, {"double": ["value"]})


def _registration_sql() -> str:
    parts = [f"coalesce(CAST({c} AS {t}), CAST({s!r} AS {t})) AS {n}"
             for n, (c, t, s) in silver.REGISTRATION_VALUES.items()]
    parts += [f"coalesce(CAST(try_strptime({c}, '%d/%m/%Y') AS DATE), DATE '{d}') AS {n}"
              for n, (c, d) in silver.REGISTRATION_DATES.items()]
    parts += [f"CAST({c} IS NULL AS INTEGER) AS {n}" for n, c in silver.REGISTRATION_MISSING.items()]
    parts += [f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END AS {n}" if v is None else
              f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS {n}" for n, (c, v) in silver.REGISTRATION_PRESENCE.items()]
    made = ", ".join(parts)
    return (f"SELECT NUM_CPF || CAST(SAFRA AS VARCHAR) AS ID_UNICO, substr(NUM_CPF, 6, 2) IN ('ZZ', 'ZX') AS "
            f"GRUPO_CONTROLE, NUM_CPF, SAFRA, PROD, FLAG_INSTALACAO, FPD, {made} FROM ({RAW_REGISTRATION_SQL})")


SILVER_REGISTRATION_SQL = _registration_sql()


_REGISTRATION_DATES = ("DATA_FUNC_PRIVADO", "DATADENASCIMENTO")


@query("conform_registration_table", plain_sql(
    SILVER_REGISTRATION_SQL, ["VALOR_EMPR_DIRETOR", "BENEFICIO_BOLSA_FAMILIA", "var_07_MONETARIO"], _REGISTRATION_DATES))
def _(t):
    return plain(silver.registration(raw_registration(t)), _REGISTRATION_DATES)


@query("conform_score_table", f"""
SELECT NUM_CPF || CAST(SAFRA AS VARCHAR) AS ID_UNICO, substr(NUM_CPF, 6, 2) IN ('ZZ', 'ZX') AS GRUPO_CONTROLE,
       NUM_CPF, SAFRA, FLAG_INSTALACAO, PROD, FPD, flag_mig2,
       coalesce(CAST(SCORE_01 AS INTEGER), -1) AS SCORE_01, CAST(SCORE_01 IS NULL AS INTEGER) AS SCORE_01_MISSING,
       coalesce(CAST(SCORE_02 AS INTEGER), -1) AS SCORE_02, CAST(SCORE_02 IS NULL AS INTEGER) AS SCORE_02_MISSING
FROM ({RAW_SCORE_SQL})""")
def _(t):
    return silver.score(raw_score(t))


# --- dates -------------------------------------------------------------------

@query("date_parse_mask", """
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders),
x AS (SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE day END AS stamped,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE day END AS slashed, day FROM d)
SELECT o_orderkey, CAST(coalesce(stamped, DATE '9999-12-31') AS VARCHAR) AS stamped, slashed,
       CAST(date_trunc('month', day) AS DATE) AS vintage FROM x""")
def _(t):
    stamp = F.upper(F.date_format("o_orderdate", "ddMMMyyyy:HH:mm:ss"))
    df = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", stamp).alias("s"),
        F.when(F.col("o_orderstatus") == "F", F.lit("31/02/2020")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("d"),
        F.date_format("o_orderdate", "yyyyMM").alias("v"))
    out = df.select("o_orderkey", dates.parse_day("s", default=K.OPEN_END).alias("stamped"),
                    dates.parse_day("d", K.DAY_MASK).alias("slashed"), dates.vintage_start("v").alias("vintage"))
    return plain(out, ("stamped",))


@query("date_year_month_parts", """
SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_shipdate AS DATE) AS day,
       CAST(year(l_shipdate) AS INTEGER) AS ano, CAST(month(l_shipdate) AS INTEGER) AS mes FROM lineitem""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))
    return df.withColumns(dates.part_columns("day", "ano", "mes"))


MONTHS_BETWEEN = """CASE WHEN day({a}) = day({b}) OR ({a} = last_day({a}) AND {b} = last_day({b}))
  THEN CAST((year({a}) - year({b})) * 12 + month({a}) - month({b}) AS DOUBLE)
  ELSE round((year({a}) - year({b})) * 12 + month({a}) - month({b}) + (day({a}) - day({b})) / 31.0, 8) END"""


@query("date_age_years", f"""
WITH d AS (SELECT NUM_CPF, SAFRA, CAST(strptime(CAST(SAFRA AS VARCHAR) || '01', '%Y%m%d') AS DATE) AS a,
   coalesce(CAST(try_strptime(DATADENASCIMENTO, '%d/%m/%Y') AS DATE), DATE '1000-01-01') AS b FROM ({RAW_REGISTRATION_SQL}))
SELECT NUM_CPF, SAFRA, CAST(CASE WHEN b = DATE '1000-01-01' THEN -4
   ELSE floor(({MONTHS_BETWEEN.format(a='a', b='b')}) / 12) END AS INTEGER) AS idade FROM d""")
def _(t):
    df = silver.registration(raw_registration(t))
    return df.select("NUM_CPF", "SAFRA", dates.age_years(dates.vintage_start("SAFRA"), "DATADENASCIMENTO").alias("idade"))


@query("date_tenure_months", f"""
WITH d AS (SELECT o_orderkey, DATE '2001-08-01' AS a,
   CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS b FROM orders)
SELECT o_orderkey, coalesce(round({MONTHS_BETWEEN.format(a='a', b='b')}, 0), -1.0) AS tenure FROM d""")
def _(t):
    start = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", dates.tenure_months(F.lit("2001-08-01").cast("date"), start).alias("tenure"))


@query("date_guarded_delay", """
WITH d AS (SELECT l_orderkey, l_partkey, l_linenumber,
   CASE WHEN l_linenumber = 7 THEN DATE '1900-01-01' ELSE CAST(l_shipdate AS DATE) END AS paid,
   CASE WHEN o_orderpriority = '1-URGENT' THEN DATE '9999-12-31' ELSE CAST(o_orderdate AS DATE) END AS due
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT *, CAST(CASE WHEN paid > DATE '1900-01-01' AND due < DATE '9999-12-31' THEN paid - due ELSE 0 END AS INTEGER)
   AS days FROM d)
SELECT l_orderkey, l_partkey, l_linenumber, days, CAST(days > 0 AS INTEGER) AS late FROM x""")
def _(t):
    df = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 7, F.lit(K.OPEN_START).cast("date")).otherwise(F.to_date("l_shipdate")).alias("paid"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(K.OPEN_END).cast("date")).otherwise(F.to_date("o_orderdate")).alias("due"))
    df = df.select("l_orderkey", "l_partkey", "l_linenumber", dates.days_late("paid", "due").alias("days"))
    return df.withColumn("late", dates.late_flag("days"))


# --- text --------------------------------------------------------------------

@query("str_token_count", """
SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS tokens,
       CAST(CASE WHEN lang = 'de' THEN 0 ELSE len(string_split(lang || ' ' || source, ' ')) END AS INTEGER) AS sources
FROM documents""")
def _(t):
    joined = F.when(F.col("lang") == "de", "SEM_INFORMACAO").otherwise(F.concat_ws(" ", "lang", "source"))
    return t.documents.select("doc_id", text.token_count("text").alias("tokens"),
                              text.token_count(joined, "SEM_INFORMACAO").alias("sources"))


@query("str_substring_key", f"""
SELECT ID_UNICO, right(ID_UNICO, 8) AS label, substr(ID_UNICO, 1, 2) AS head,
       CAST(strptime(right(CAST(NUM_CPF AS VARCHAR) || CAST(SAFRA // 100 AS VARCHAR), 6) || '01', '%Y%m%d') AS DATE) AS vintage
FROM ({WEEKLY_SPINE})""")
def _(t):
    monthly = text.key_of("NUM_CPF", F.floor(F.col("SAFRA") / 100))
    return weekly_spine(t).select("ID_UNICO", F.right("ID_UNICO", F.lit(8)).alias("label"),
                                  F.substring("ID_UNICO", 1, 2).alias("head"), dates.vintage_from_key(monthly).alias("vintage"))


@query("str_label_number", r"""
SELECT p_partkey, CAST(nullif(regexp_extract(p_brand, '([-+]?\d*\.\d+|\d+)', 1), '') AS DOUBLE) AS brand_number,
       CAST(nullif(regexp_extract('(' || CAST(p_retailprice AS DECIMAL(18,2)) || ', x]', '([-+]?\d*\.\d+|\d+)', 1), '') AS DOUBLE) AS edge
FROM part""")
def _(t):
    label = F.concat(F.lit("("), values.money("p_retailprice").cast("string"), F.lit(", x]"))
    return t.part.select("p_partkey", text.first_number("p_brand").alias("brand_number"), text.first_number(label).alias("edge"))


@query("str_value_map", """
SELECT l_orderkey, l_partkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN 'Contratou' WHEN 'F' THEN 'Não Contratou' END AS label,
       CASE l_returnflag WHEN 'A' THEN 'Aberto' ELSE 'Outro' END AS mapped
FROM lineitem""")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        values.label_map("l_linestatus", {"O": "Contratou", "F": "Não Contratou"}).alias("label"),
        values.label_map("l_returnflag", {"A": "Aberto"}, "Outro").alias("mapped"))


@query("str_clean_identifier", """
SELECT o_orderkey, upper(regexp_replace(regexp_replace(o_orderpriority, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name
FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", text.clean_label_column("o_orderpriority").alias("name"))


# --- projection --------------------------------------------------------------

@query("proj_ordered", "SELECT p_size, p_partkey, p_brand FROM part")
def _(t):
    return frames.project(t.part, ["p_size", "p_partkey", "p_brand"])


@query("proj_simultaneous", "SELECT c_custkey, c_acctbal * 2 AS c_acctbal, c_acctbal + 1 AS plus FROM customer")
def _(t):
    return t.customer.withColumns({"c_acctbal": F.col("c_acctbal") * 2, "plus": F.col("c_acctbal") + 1}).drop(
        "c_name", "c_nationkey", "c_mktsegment")


@query("proj_new_columns_only", "SELECT s_nationkey, s_acctbal, s_suppkey FROM supplier")
def _(t):
    names = frames.new_columns(["s_name"], t.supplier.columns, "s_nationkey")
    return t.supplier.select(*names)


@query("proj_rename_sanitised", """
SELECT p_partkey, p_name AS X_P_NAME, p_brand AS X_P_BRAND, p_type AS X_P_TYPE, p_size AS X_P_SIZE,
       p_retailprice AS X_P_RETAILPRICE FROM part""")
def _(t):
    return frames.rename_clean(t.part, "X_", keep=["p_partkey"])


@query("rowwise_flag_sum", """
SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS SEG_BUILDING,
       CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS SEG_MACHINERY,
       CAST(c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS INTEGER) AS nenhum
FROM customer""")
def _(t):
    from riskmart.functions.encoders import none_of, one_hot
    flags = one_hot("c_mktsegment", ["BUILDING", "MACHINERY"], "SEG_")
    return t.customer.withColumns(flags).withColumn("nenhum", none_of(list(flags))).select("c_custkey", *flags, "nenhum")


# --- filters and splits ------------------------------------------------------

@query("filter_target_notnull", f"""
SELECT 'com' AS kind, count(*) AS n FROM ({RAW_SCORE_SQL}) WHERE FPD IS NOT NULL
UNION ALL SELECT 'sem', count(*) FROM ({RAW_SCORE_SQL}) WHERE FPD IS NULL""")
def _(t):
    df = raw_score(t)
    n = lambda x, k: x.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return n(frames.has_target(df), "com").unionByName(n(frames.without_target(df), "sem"))


@query("filter_before_cutoff", """
SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15'""")
def _(t):
    # midnight of the cutoff day against the stored timestamp: the filter reaches the parquet scan
    early = t.events.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return early.select("event_id", "user_id", F.to_date("ts").alias("day"))


@query("filter_domain", f"""
SELECT NUM_CPF, SAFRA, STATUSRF FROM ({RAW_REGISTRATION_SQL}) WHERE STATUSRF <> 'NULA'""")
def _(t):
    return frames.exclude_value(raw_registration(t), "STATUSRF", "NULA").select("NUM_CPF", "SAFRA", "STATUSRF")


@query("filter_age_rule", """
SELECT p_partkey, p_size - 5 AS idade FROM part WHERE p_size - 5 < 0 OR p_size - 5 >= 18""")
def _(t):
    return frames.adults_or_unknown(t.part.select("p_partkey", (F.col("p_size") - 5).alias("idade")), "idade")


@query("filter_valid_score", f"""
SELECT ID_UNICO, SCORE_01 FROM (
  SELECT NUM_CPF || CAST(SAFRA AS VARCHAR) AS ID_UNICO, substr(NUM_CPF, 6, 2) IN ('ZZ', 'ZX') AS gc,
         coalesce(CAST(SCORE_01 AS INTEGER), -1) AS SCORE_01 FROM ({RAW_SCORE_SQL})) WHERE gc AND SCORE_01 <> -1""")
def _(t):
    df = silver.score(raw_score(t)).withColumn(K.CONTROL, F.col(K.CONTROL).cast("int"))
    return frames.valid_scores(df, "SCORE_01", -1, control=K.CONTROL).select("ID_UNICO", "SCORE_01")


@query("filter_unmapped_code", f"""
SELECT NUM_CPF, SAFRA, coalesce(var_08 NOT IN (-999, 41, 42, 32, 21, 31, 91, 80, 87, 88), FALSE) AS unmapped
FROM ({RAW_REGISTRATION_SQL})""")
def _(t):
    known = [-999, *[c for g in K.PENSION_GROUPS.values() for c in g]]
    return raw_registration(t).select("NUM_CPF", "SAFRA", frames.not_in_list("var_08", known).alias("unmapped"))


@query("split_oot_flag", f"""
SELECT NUM_CPF, SAFRA, CAST(SAFRA IN (200102, 200103) AS INTEGER) AS Flag_OOT FROM ({RAW_SCORE_SQL})""")
def _(t):
    return raw_score(t).select("NUM_CPF", "SAFRA", splits.oot_flag("SAFRA", [200102, 200103]).alias("Flag_OOT"))


def _tables(t):
    s = silver.score(raw_score(t))
    return {"score_01": s.select("ID_UNICO", "SAFRA", "GRUPO_CONTROLE", "FPD", "SCORE_01"),
            "score_02": s.select("ID_UNICO", "SAFRA", "GRUPO_CONTROLE", "FPD", "SCORE_01", "SCORE_02")}


_SPLIT_BASE = f"""SELECT NUM_CPF, SAFRA, substr(NUM_CPF, 6, 2) IN ('ZZ', 'ZX') AS gc,
  coalesce(SCORE_02, -1) AS s2, NUM_CPF || CAST(SAFRA AS VARCHAR) AS ID_UNICO FROM ({RAW_SCORE_SQL})"""


@query("split_control", f"""
SELECT ID_UNICO, SAFRA, CASE WHEN gc THEN 'score_01_gc' WHEN SAFRA IN (200102, 200103) THEN 'oot' ELSE 'treino' END AS part
FROM ({_SPLIT_BASE})""")
def _(t):
    tables = {"score_01": _tables(t)["score_01"]}
    kept, control = splits.remove_control(tables)
    pair = splits.split_train_oot(kept, [200102, 200103])["score_01"]
    mark = lambda df, k: df.select("ID_UNICO", "SAFRA", F.lit(k).alias("part"))
    return (mark(pair["treino"], "treino").unionByName(mark(pair["oot"], "oot"))
            .unionByName(mark(control["score_01_gc"], "score_01_gc")))


@query("split_counts", f"""
WITH b AS (SELECT *, CASE WHEN gc THEN 'controle' WHEN SAFRA IN (200102, 200103) THEN 'oot' ELSE 'treino' END AS split
           FROM ({_SPLIT_BASE}))
SELECT 'score_01' AS table_name, split, count(*) AS n_rows FROM b GROUP BY split
UNION ALL SELECT 'score_02', split, count(*) FROM b GROUP BY split""")
def _(t):
    _, counts, _ = splits.prepare(_tables(t), [200102, 200103])
    return counts
