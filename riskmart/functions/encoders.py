"""Named feature encoders."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.functions.text import clean_label
from riskmart.functions.values import as_column, flag


def one_hot(c: Column | str, domain: Iterable | Mapping, prefix: str = "") -> dict[str, Column]:
    """One 0/1 column per value of a fixed domain.

    ``domain`` is a list of values, or a mapping of column name to value (or to a
    list of values).
    """
    c = as_column(c)
    if not isinstance(domain, Mapping):
        domain = {f"{prefix}{clean_label(v)}": v for v in domain}
    return {
        name: flag(c.isin(v) if isinstance(v, list) else c == F.lit(v))
        for name, v in domain.items()
    }


def none_of(columns: Sequence[str]) -> Column:
    """1 when every one of the given 0/1 columns is 0."""
    return flag(reduce(add, [F.col(x) for x in columns]) == 0)


def bands(c: Column | str, limits: Sequence[tuple[str, Column]]) -> dict[str, Column]:
    return {name: flag(cond) for name, cond in limits}


def age_bands(age: Column | str, prefix: str = "IDADE_") -> dict[str, Column]:
    a = as_column(age)
    return bands(a, [
        (prefix + "AUSENTE", a == K.UNKNOWN),
        (prefix + "ATE_29", (a > 0) & (a < 30)),
        (prefix + "30_44", (a >= 30) & (a < 45)),
        (prefix + "45_60", (a >= 45) & (a <= 60)),
        (prefix + "60_99", (a > 60) & (a < 100)),
        (prefix + "CENTENARIO", a >= 100),
    ])


def interval_label(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed intervals ``(e0, e1], (e1, e2] ...``; outside is null."""
    c = as_column(c)
    out = F.when(c <= edges[0], F.lit(None))
    for upper, text in zip(edges[1:], labels):
        out = out.when(c <= upper, F.lit(text))
    return out


def report_age_label(age: Column | str) -> Column:
    return interval_label(age, [-5, 0, 25, 35, 45, 60, 100],
                          ["Não Declarada", "Até 25", "26-35", "36-45", "46-60", "60+"])


def tenure_bands(months: Column | str, prefix: str = "FLG_EMPREGO_CLT_") -> dict[str, Column]:
    m = as_column(months)
    return bands(m, [
        (prefix + "NOVO_ATE_1_ANO", (m >= 0) & (m < 12)),
        (prefix + "1_A_3_ANOS", (m >= 12) & (m < 36)),
        (prefix + "3_A_5_ANOS", (m >= 36) & (m < 60)),
        (prefix + "MAIS_DE_5_ANOS", m >= 60),
    ])


def code_groups(c: Column | str, groups: Mapping[str, list], other: str, ignore: Iterable = ()) -> dict[str, Column]:
    """A flag per code group, plus one for codes that are in no group and not ignored."""
    c = as_column(c)
    known = [v for codes in groups.values() for v in codes] + list(ignore)
    return {**one_hot(c, groups), other: flag(~c.isin(known))}


def day_part(hhmmss: Column | str) -> Column:
    """Part of the day from an ``HHmmss`` integer; null falls in the last part."""
    hour = F.substring(F.lpad(as_column(hhmmss).cast("string"), 6, "0"), 1, 2).cast("int")
    dawn, morning, afternoon, night = K.DAY_PARTS
    return (F.when(hour < 6, dawn).when(hour < 12, morning).when(hour < 18, afternoon)
            .otherwise(night))


def first_match(c: Column | str, patterns: Sequence[tuple[str, str]], otherwise: str,
                exact: Mapping[str, str] | None = None) -> Column:
    """Label of the first regular expression that matches; exact values come first."""
    c = as_column(c)
    rules = [(c == F.lit(v), label) for v, label in (exact or {}).items()]
    rules += [(c.rlike(p), label) for label, p in patterns]
    out = F.when(rules[0][0], rules[0][1])
    for condition, label in rules[1:]:
        out = out.when(condition, label)
    return out.otherwise(otherwise)


def channel_class(c: Column | str) -> Column:
    return first_match(c, K.CHANNEL_PATTERNS, "OUTROS",
                       {"NI": K.NOT_INFORMED_TEXT, "ND": K.NOT_DECLARED_TEXT})


def plan_cluster(c: Column | str) -> Column:
    return first_match(c, K.PLAN_PATTERNS, "NICHO/OUTROS", {"-4": K.UNKNOWN_TEXT})


def tiers(c: Column | str, steps: Sequence[tuple[float, object]], above, first_equals: bool = True) -> Column:
    """Value of the first step whose bound is not exceeded.

    With ``first_equals`` the first step applies to its exact bound only.
    """
    c = as_column(c)
    (bound, value), rest = steps[0], steps[1:]
    out = F.when(c == F.lit(bound) if first_equals else c <= F.lit(bound), F.lit(value))
    for bound, value in rest:
        out = out.when(c <= F.lit(bound), F.lit(value))
    return out.otherwise(F.lit(above))


def sos_fee(c: Column | str) -> Column:
    return tiers(c, K.SOS_FEES, K.SOS_FEE_ABOVE)


def interest_tier(c: Column | str) -> Column:
    return tiers(c, K.INTEREST_TIERS, K.INTEREST_ABOVE)


def allow_list(c: Column | str, keep: Iterable[str], undetermined: str | None = "-2") -> Column:
    """Keep listed values, name the undetermined code, everything else is OUTROS."""
    c = as_column(c)
    out = F.when(c.isin(list(keep)), c)
    if undetermined is not None:
        out = F.when(c == undetermined, F.lit("NAO_DETERMINADO")).when(c.isin(list(keep)), c)
    return out.otherwise(F.lit("OUTROS"))


def delay_status(days: Column | str) -> Column:
    d = as_column(days)
    return (F.when(d.isNull(), "SEM_STATUS").when(d > 0, "ATRASADO").when(d == 0, "EM_DIA")
            .otherwise("ADIANTADO"))


def code_name(c: Column | str, mapping: Mapping[str, str], default: str = "OUTROS") -> Column:
    out = None
    for code, name in mapping.items():
        hit = as_column(c).cast("string") == F.lit(code)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def bank_cluster(c: Column | str) -> Column:
    c = as_column(c)
    return (F.when(c == "-3", "NAO_INFORMADO").when(c == "NT1", "NT1")
            .when(c.isin(K.TRADITIONAL_BANKS), "TRADICIONAL")
            .when(c.isin(K.FINTECH_BANKS), "FINTECH").otherwise("OUTROS"))


def platform_bucket(c: Column | str) -> Column:
    return code_name(c, {"Pré Pago": "PRE_PAGO", "Controle": "CONTROLE", "Pós Pago": "POS_PAGO"})


def majority_label(mean_flag: Column, yes: str = "OOT (Teste)", no: str = "Treino") -> Column:
    return F.when(mean_flag > 0.5, yes).otherwise(no)
