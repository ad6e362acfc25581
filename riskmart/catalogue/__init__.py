"""Registered queries over the driver tables, each with its SQL check where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.session import size_parts
from riskmart.sources.readers import stored_bytes


class Tables:
    """Lazy access to the parquet tables of one scale-factor folder.

    The parts of the shuffles grow with the tables that a query reads.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._sizes = spark, folder, {}
        size_parts(spark, 0)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.folder}/{name}.parquet"
        if name not in self._sizes:
            self._sizes[name] = stored_bytes(self.spark, path)
            size_parts(self.spark, sum(self._sizes.values()))
        return self.spark.read.parquet(path)


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


def plain(df: DataFrame, texts: tuple[str, ...] = ()) -> DataFrame:
    """Decimals and floats as double and the listed sentinel dates as ISO text, for comparison outside Spark."""
    made = {f.name: F.col(f"`{f.name}`").cast("double") for f in df.schema if isinstance(f.dataType, (T.DecimalType, T.FloatType))}
    return df.withColumns({**made, **{c: F.col(c).cast("string") for c in texts}})


def plain_sql(sql: str, doubles: tuple[str, ...] | list[str] = (), texts: tuple[str, ...] = ()) -> str:
    casts = [f"CAST({c} AS DOUBLE) AS {c}" for c in doubles] + [f"CAST({c} AS VARCHAR) AS {c}" for c in texts]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})"


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name."""
    def add(build):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(build, sql)
        return build
    return add


def load() -> dict[str, Query]:
    """All registered queries."""
    from riskmart.catalogue import (conforming, conforming_tables, encoding, joining, books, base_table, profiling,  # noqa: F401
                                    evaluation, statistics, modelling, storage)
    return REGISTRY
