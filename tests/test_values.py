import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.functions import dates, encoders as enc, text, values


def col(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_typed_or_null_valid_malformed_and_sentinel(spark):
    df = spark.createDataFrame([(None,), ("7",), ("x7",), ("-4",)], "a string")
    assert col(df, values.typed_or("a", "int", -4)) == [-4, 7, -4, -4]
    assert col(df, values.missing_flag("a")) == [1, 0, 0, 0]
    assert col(df, values.presence_flag("a")) == [0, 1, 1, 1]
    assert col(df, values.presence_flag("a", "7")) == [0, 1, 0, 0]


def test_recode_cap_floor_delta(spark):
    df = spark.createDataFrame([(-999.0, 5), (None, -1), (20.0, 3)], "a double, b int")
    assert col(df, values.recode("a", {-999.0: -4.0})) == [-4.0, None, 20.0]
    assert col(df, values.capped("a", 10.0)) == [-999.0, None, 10.0]
    assert col(df, values.anomaly_flag("a", 10.0)) == [0, 0, 1]
    assert col(df, values.floor_at_zero("a")) == [0.0, None, 20.0]
    assert col(df, values.floor_at_zero("a", F.col("b") == 0)) == [-999.0, None, 20.0]
    assert col(df, values.guarded_delta("b", F.lit(1))) == [4, -9999, 2]


def test_rounding_is_half_up_on_decimals(spark):
    df = spark.createDataFrame([(2.675,), (-2.675,), (0.125,), (None,)], "a double")
    assert col(df, values.rounded("a")) == [2.68, -2.68, 0.13, None]


def test_ratio_guards_the_denominator(spark):
    df = spark.createDataFrame([(1, 3), (1, 0), (1, -2), (1, None)], "a int, b int")
    assert col(df, values.ratio(F.col("a"), F.col("b"), 2)) == [0.33, 0.0, 0.0, 0.0]


def test_dates_by_mask(spark):
    df = spark.createDataFrame(
        [("07MAY2010:11:23:38",), ("07may2010:11:23:38",), ("31FEB2020:00:00:00",), (None,)], "a string")
    day = dt.date(2010, 5, 7)
    assert col(df, dates.parse_day("a")) == [day, day, None, None]
    assert col(df, dates.parse_day("a", default=K.OPEN_END)) == [day, day, dt.date(9999, 12, 31), dt.date(9999, 12, 31)]
    slashed = spark.createDataFrame([("28/02/2021",), ("29/02/2021",)], "a string")
    assert col(slashed, dates.parse_day("a", K.DAY_MASK)) == [dt.date(2021, 2, 28), None]


def test_open_dates_do_not_enter_arithmetic(spark):
    df = spark.createDataFrame([("1900-01-01", "2020-01-05"), ("2020-01-10", "9999-12-31"), ("2020-01-10", "2020-01-05")],
                               "p string, d string").select(F.col("p").cast("date").alias("p"), F.col("d").cast("date").alias("d"))
    assert col(df, dates.days_late("p", "d")) == [0, 0, 5]
    late = F.datediff(values.null_if_open_date("p"), values.null_if_open_date("d"))
    assert col(df, late) == [None, None, 5]
    assert col(df, enc.delay_status(late)) == ["SEM_STATUS", "SEM_STATUS", "ATRASADO"]


def test_age_tenure_and_vintage(spark):
    df = spark.createDataFrame([("1990-02-02",), ("1990-02-01",), ("1000-01-01",), (None,)], "b string").select(
        F.col("b").cast("date").alias("b"))
    ref = dates.vintage_start(F.lit(202002))
    assert col(df, dates.age_years(ref, "b")) == [29, 30, -4, None]
    assert col(df.limit(1), dates.tenure_months(ref, F.lit(None).cast("date"))) == [-1.0]
    assert col(df.limit(1), dates.vintage_from_key(F.lit("123202403"))) == [dt.date(2024, 3, 1)]


@pytest.mark.parametrize("amount, fee", [(0, 0), (0.01, 1), (3, 1), (3.01, 2), (5, 2), (10, 3.5), (15, 5), (20, 6), (20.01, 7), (-1, 1)])
def test_fee_tiers(spark, amount, fee):
    assert spark.range(1).select(enc.sos_fee(F.lit(float(amount)))).first()[0] == fee


def test_day_part_and_lists(spark):
    df = spark.createDataFrame([(0,), (55959,), (60000,), (120000,), (235959,), (None,)], "h int")
    assert col(df, enc.day_part("h")) == ["MADRUGADA", "MADRUGADA", "MANHA", "TARDE", "NOITE", "NOITE"]
    cards = spark.createDataFrame([("UB",), ("-2",), ("??",), (None,)], "c string")
    assert col(cards, enc.allow_list("c", K.TOP_CARDS)) == ["UB", "NAO_DETERMINADO", "OUTROS", "OUTROS"]
    banks = spark.createDataFrame([("-3",), ("NT1",), ("104",), ("212",), ("x",)], "b string")
    assert col(banks, enc.bank_cluster("b")) == ["NAO_INFORMADO", "NT1", "TRADICIONAL", "FINTECH", "OUTROS"]


def test_first_matching_pattern_wins(spark):
    df = spark.createDataFrame([("NI",), ("ND",), ("Loja ITAU Epay",), ("rd cpay",), ("[RD] loja",), ("rv x",), ("zzz",), (None,)], "c string")
    assert col(df, enc.channel_class("c")) == [
        "NAO INFORMADO", "NAO DECLARADO", "BANCOS TRADICIONAL", "FINTECH OU CARTEIRA DIGITAL",
        "VAREJO FÍSICO / DINHEIRO VIVO", "GATEWAYS / CAMPANHAS", "OUTROS", "OUTROS"]
    plans = spark.createDataFrame([("-4",), ("prezao 9",), ("Cont35",), ("zb7",), ("th x",), ("Foo",)], "c string")
    assert col(plans, enc.plan_cluster("c")) == ["DESCONHECIDO", "PRE-PAGO CORE", "PLANO CONTROLE",
                                                 "PRE-PAGO REGIONAL/CAMPANHA", "PRE-PAGO LEGADO", "NICHO/OUTROS"]


def test_bands_cover_their_limits(spark):
    ages = spark.createDataFrame([(-4,), (29,), (30,), (44,), (45,), (60,), (61,), (99,), (100,), (0,)], "a int")
    rows = ages.select(*[c.alias(n) for n, c in enc.age_bands("a").items()]).collect()
    hit = [[n for n, v in r.asDict().items() if v] for r in rows]
    assert hit == [["IDADE_AUSENTE"], ["IDADE_ATE_29"], ["IDADE_30_44"], ["IDADE_30_44"], ["IDADE_45_60"], ["IDADE_45_60"],
                   ["IDADE_60_99"], ["IDADE_60_99"], ["IDADE_CENTENARIO"], []]
    edges = spark.createDataFrame([(-5,), (-4,), (0,), (25,), (26,), (100,), (101,)], "a int")
    assert col(edges, enc.report_age_label("a")) == [None, "Não Declarada", "Não Declarada", "Até 25", "26-35", "60+", None]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a  b",), ("SEM_INFORMACAO",), ("x",)], "c string")
    assert col(df, text.token_count("c", "SEM_INFORMACAO")) == [3, 0, 1]
    assert [text.clean_label(v) for v in ("Rec.Online", "ChipPre+R$30", "__a--b__", "PRÉ-PAGO")] == [
        "REC_ONLINE", "CHIPPRE_R_30", "A_B", "PR_PAGO"]
    labels = spark.createDataFrame([("(10.5, 20.0]",), ("S/ Info",), ("-3",)], "c string")
    assert col(labels, text.first_number("c")) == [10.5, None, 3.0]
    ids = spark.createDataFrame([("12345ZZ9",), ("12345ZX9",), ("ZZ345AA9",)], "c string")
    assert col(ids, text.control_flag("c", K.CONTROL_MARKS)) == [True, True, False]


def test_one_hot_null_is_zero_everywhere(spark):
    df = spark.createDataFrame([("A",), (None,), ("C",)], "c string")
    flags = enc.one_hot("c", ["A", "B"], "X_")
    out = df.withColumns(flags).withColumn("none", enc.none_of(list(flags))).select("X_A", "X_B", "none").collect()
    assert [tuple(r) for r in out] == [(1, 0, 0), (0, 0, 1), (0, 0, 1)]
