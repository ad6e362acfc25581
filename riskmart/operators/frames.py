"""Projection, join, fill and filter operators on whole frames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart import constants as K
from riskmart.functions.text import clean_label
from riskmart.functions.values import as_column, recode


# --- projection --------------------------------------------------------------

def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fixed-order projection; all missing names are reported at once."""
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in required if c not in have]


def new_columns(base: Sequence[str], extra: Sequence[str], key: str = K.ID) -> list[str]:
    """The key and the columns of ``extra`` that ``base`` does not have."""
    have = set(base)
    return [key] + [c for c in extra if c != key and c not in have]


def rename_clean(df: DataFrame, prefix: str, keep: Iterable[str] = ()) -> DataFrame:
    keep = set(keep)
    return df.withColumnsRenamed({c: f"{prefix}{clean_label(c)}" for c in df.columns if c not in keep})


def cast_group(df: DataFrame, groups: Mapping[str, Sequence[str]], default=None) -> DataFrame:
    """Bulk cast: type -> columns, with an optional default for null or malformed values."""
    exprs = {}
    for dtype, names in groups.items():
        for n in names:
            c = F.col(n).try_cast(dtype)
            exprs[n] = c if default is None else F.coalesce(c, F.lit(default).cast(dtype))
    return df.withColumns(exprs)


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Decimal columns to double, in place, for a model matrix."""
    return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema
                           if isinstance(f.dataType, T.DecimalType)})


def texts_to_number(df: DataFrame, skip: Iterable[str] = ()) -> DataFrame:
    """Text features to double; text that is not a number becomes null."""
    skip = set(skip)
    return df.withColumns({f.name: F.col(f.name).try_cast("double") for f in df.schema
                           if isinstance(f.dataType, T.StringType) and f.name not in skip})


def round_columns(df: DataFrame, names: Sequence[str], places: int = 2) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


def recode_columns(df: DataFrame, names: Sequence[str], mapping: Mapping) -> DataFrame:
    return df.withColumns({n: recode(n, mapping) for n in names})


# --- fills -------------------------------------------------------------------

_NUMERIC = (T.NumericType,)


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Null fill that refuses columns whose type cannot take the value."""
    types = {f.name: f.dataType for f in df.schema}
    for name, v in values.items():
        if name not in types:
            raise ValueError(f"unknown column {name}")
        ok = isinstance(types[name], T.StringType) if isinstance(v, str) else isinstance(types[name], _NUMERIC)
        if not ok:
            raise TypeError(f"cannot fill {name} ({types[name].simpleString()}) with {v!r}")
    return df.fillna(dict(values)) if values else df


def fill_plan(columns: Iterable[str], default, prefixes: Mapping[str, object] | None = None,
              named: Mapping[object, Iterable[str]] | None = None) -> dict[str, object]:
    """Value per column: named lists win, then name prefixes, then the default."""
    chosen = {c: v for v, names in (named or {}).items() for c in names}
    out = {}
    for c in columns:
        by_prefix = next((v for p, v in (prefixes or {}).items() if c.startswith(p)), default)
        out[c] = chosen.get(c, by_prefix)
    return out


# --- joins -------------------------------------------------------------------

def enrich(fact: DataFrame, dim: DataFrame, columns: Sequence[str], on: str, dim_key: str | None = None,
           drop_key: bool = True) -> DataFrame:
    """Left join of a projected dimension.

    ``dim_key`` names the dimension's key when it differs; it is then kept and the
    fact key dropped. No broadcast is forced: the size threshold of the session and
    the sizes seen at run time decide.
    """
    if dim_key is None or dim_key == on:
        side = dim.select(on, *[c for c in columns if c != on])
        out = fact.join(side, on, "left")
        return out.drop(on) if drop_key else out
    side = dim.select(dim_key, *[c for c in columns if c != dim_key])
    out = fact.join(side, fact[on] == side[dim_key], "left")
    return out.drop(fact[on]) if drop_key else out


def literal_rows(spark: SparkSession, rows: Sequence[tuple], like: DataFrame | T.StructType | str) -> DataFrame:
    """Literal rows with the schema of another frame."""
    schema = like.schema if isinstance(like, DataFrame) else like
    if isinstance(schema, T.StructType):
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    return spark.createDataFrame(list(rows), schema)


def with_members(dim: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """Append sentinel members so that every fact key finds a row; duplicates are kept."""
    return dim.unionByName(literal_rows(dim.sparkSession, rows, dim))


def patch_by_key(dim: DataFrame, key: str, patches: Mapping[str, Mapping]) -> DataFrame:
    """Overwrite dependent columns for special key values: column -> {key value: new value}."""
    exprs = {}
    for name, by_value in patches.items():
        out = None
        for v, new in by_value.items():
            hit = F.col(key) == F.lit(v)
            out = F.when(hit, F.lit(new)) if out is None else out.when(hit, F.lit(new))
        exprs[name] = out.otherwise(F.col(name))
    return dim.withColumns(exprs)


def attach(base: DataFrame, extra: DataFrame, key: str = K.ID, probe: str | None = None,
           miss_flag: str | None = None, fills=None) -> DataFrame:
    """Left attach of a step on its unique key, the population of ``base`` preserved.

    Only columns new to ``base`` are brought. ``miss_flag`` becomes 1 where ``probe``
    found no partner, and is computed before any fill. ``fills`` maps the new column
    names to their fill value, or is a function from names to such a map.
    """
    names = new_columns(base.columns, extra.columns, key)
    out = base.join(extra.select(*names), key, "left")
    if miss_flag:
        out = out.withColumn(miss_flag, F.col(probe).isNull().cast("int"))
    if fills is not None:
        out = fill(out, fills(names[1:]) if callable(fills) else fills)
    return out


# --- filters -----------------------------------------------------------------

def has_target(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def without_target(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    return df.where(F.col(target).isNull())


def exclude_value(df: DataFrame, column: str, value) -> DataFrame:
    """Drop one domain value; rows with a null drop too."""
    return df.where(F.col(column) != F.lit(value))


def adults_or_unknown(df: DataFrame, age: str = "IDADE", minimum: int = 18) -> DataFrame:
    return df.where((F.col(age) < 0) | (F.col(age) >= minimum))


def valid_scores(df: DataFrame, score: str, sentinel=K.NOT_APPLICABLE, control: str | None = None) -> DataFrame:
    """Rows with a real score, optionally of the control group only."""
    out = df.where(F.col(score) != F.lit(sentinel))
    return out if control is None else out.where(F.col(control) == 1)


def not_in_list(column: Column | str, known: Iterable) -> Column:
    """Null-safe "code is unmapped": a null code is not reported."""
    c = as_column(column)
    return F.coalesce(~c.isin(list(known)), F.lit(False))
