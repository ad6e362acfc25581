"""Category counts as columns, computed inside one grouping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.functions.text import clean_label
from riskmart.functions.values import as_column, flag
from riskmart.session import stored

#: Most values that become columns when the caller neither gives a domain nor another bound.
MAX_DOMAIN = 1000


def discover_domain(df: DataFrame, column: str, max_size: int = MAX_DOMAIN) -> list:
    """Distinct non-null values, sorted. Raises when there are too many for columns."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_size + 1).collect()
    if len(rows) > max_size:
        raise ValueError(f"{column} has more than {max_size} values: pass a domain")
    return sorted((r[0] for r in rows), key=str)


def discover_domains(df: DataFrame, columns: Sequence[str], max_size: int = MAX_DOMAIN) -> dict[str, list]:
    """Domains of several columns in one job; each as `discover_domain` gives it."""
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    kinds = [df.schema[c].dataType for c in columns]
    rows = [F.struct(F.lit(i).alias("i"), *[(F.col(c) if j == i else F.lit(None).cast(kinds[j])).alias(f"v{j}") for j, c in enumerate(columns)])
            for i, _ in enumerate(columns)]
    each = df.select(F.explode(F.array(*rows)).alias("r")).select("r.*").dropna("all", subset=[f"v{j}" for j, _ in enumerate(columns)])
    found = each.distinct().limit(len(columns) * (max_size + 1)).collect()
    out = {c: [r[1 + i] for r in found if r["i"] == i] for i, c in enumerate(columns)}
    # a full result means that some column has more values than columns are made for
    if wide := [c for c, values in out.items() if len(values) > max_size]:
        raise ValueError(f"{wide} have more than {max_size} values: pass a domain")
    return {c: sorted(values, key=str) for c, values in out.items()}


def count_map(df: DataFrame, key: str, column: str, name: str = "counts") -> DataFrame:
    """One map a key from each category to its rows, whatever the number of categories; empty for a key without any.

    Rows shrink to one for each key and category before a key's entries meet, so a key with a large share of the rows
    is counted by many tasks.
    """
    counted = df.groupBy(key, column).agg(F.count("*").alias("__n"))
    entry = F.when(F.col(column).isNotNull(), F.struct(F.col(column), F.col("__n")))
    return counted.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def map_domain(counted: DataFrame, name: str = "counts", max_size: int = MAX_DOMAIN) -> list | None:
    """Categories of a table of count maps, sorted; None if there are too many for columns."""
    rows = counted.select(F.explode(F.map_keys(name)).alias("v")).distinct().limit(max_size + 1).collect()
    return None if len(rows) > max_size else sorted((r[0] for r in rows), key=str)


def map_columns(domain: Sequence, prefix: str, name: str = "counts") -> dict[str, Column]:
    """Counts of each category read from a map; labels that clean to one name are added."""
    each = lambda v: F.coalesce(F.try_element_at(F.col(name), F.lit(v)), F.lit(0).cast("bigint"))
    return {n: reduce(Column.__add__, map(each, vs)) for n, vs in columns_of(prefix, domain).items()}


def columns_of(prefix: str, domain: Sequence) -> dict[str, list]:
    """Column name to the raw values that clean to it (colliding labels share a column)."""
    out: dict[str, list] = {}
    for v in domain:
        out.setdefault(f"{prefix}{clean_label(v)}", []).append(v)
    return out


def _is_any(c: Column, values: list) -> Column:
    return c == F.lit(values[0]) if len(values) == 1 else c.isin(values)


def count_columns(c: Column | str, domain: Sequence, prefix: str) -> dict[str, Column]:
    """Aggregates counting each category; 0 where a key has none."""
    c = as_column(c)
    return {n: F.count_if(_is_any(c, vs)) for n, vs in columns_of(prefix, domain).items()}


def flag_columns(c: Column | str, domain: Sequence, prefix: str) -> dict[str, Column]:
    """Aggregates telling whether each category occurs at all."""
    c = as_column(c)
    return {n: F.max(flag(_is_any(c, vs))) for n, vs in columns_of(prefix, domain).items()}


def pivot_counts(df: DataFrame, key: str, column: str, prefix: str, domain: Sequence | None = None,
                 max_size: int = MAX_DOMAIN) -> DataFrame:
    """``QTD_<prefix>_<category>`` frequency columns per key.

    Without a domain the counts are formed once as stored maps, which give the categories too; with more than
    ``max_size`` of them the result is one map column ``QTD_<prefix>``.
    """
    if domain is None:
        counted = stored(count_map(df, key, column, f"QTD_{prefix}"), "pivot")
        found = map_domain(counted, f"QTD_{prefix}", max_size)
        return counted if found is None else counted.select(key, *[c.alias(n) for n, c in map_columns(found, f"QTD_{prefix}_", f"QTD_{prefix}").items()])
    aggs = count_columns(column, domain, f"QTD_{prefix}_")
    return df.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])


def pivot_flags(df: DataFrame, key: str, column: str, prefix: str, domain: Sequence | None = None,
                max_size: int = MAX_DOMAIN) -> DataFrame:
    """``FLG_<prefix>_<category>`` 0/1 columns per key; beyond ``max_size`` categories one map ``FLG_<prefix>`` to 1."""
    if domain is None:
        counted = stored(count_map(df, key, column, f"FLG_{prefix}"), "pivot")
        found = map_domain(counted, f"FLG_{prefix}", max_size)
        if found is None:
            return counted.withColumn(f"FLG_{prefix}", F.transform_values(f"FLG_{prefix}", lambda k, n: F.lit(1)))
        return counted.select(key, *[(c > 0).cast("int").alias(n) for n, c in map_columns(found, f"FLG_{prefix}_", f"FLG_{prefix}").items()])
    aggs = flag_columns(column, domain, f"FLG_{prefix}_")
    return df.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])


def pivot_many(df: DataFrame, key: str, specs: Mapping[str, tuple[str, Sequence]]) -> DataFrame:
    """Several pivots of one table in a single grouping: prefix -> (column, domain)."""
    aggs: dict[str, Column] = {}
    for prefix, (column, domain) in specs.items():
        aggs.update(count_columns(column, domain, f"QTD_{prefix}_"))
    return df.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])
