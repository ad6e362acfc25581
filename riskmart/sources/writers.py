"""Parquet, CSV, split and model sinks."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.functions.dates import part_columns
from riskmart.models.boosting import BoostedModel
from riskmart.operators.splits import OOT, TRAIN, Splits
from riskmart.session import parts
from riskmart.sources.readers import _fs, exists, first_data_file, subfolders

log = logging.getLogger(__name__)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), keep_others: bool = False) -> None:
    """Overwrite the table, optionally partitioned by columns.

    With ``keep_others`` only the partitions present in ``df`` are replaced.

    A partitioned table is rebalanced first: small pieces of one partition value are
    brought together, and a value that holds a large share of the rows is split into
    several files, both from the sizes seen at run time.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if keep_others else "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_by_vintage(df: DataFrame, path: str, vintage: str = K.VINTAGE, keep_others: bool = False) -> None:
    write_parquet(df, path, [vintage], keep_others)


def store_bucketed(df: DataFrame, path: str, key: str = K.ID, buckets: int | None = None, placed: bool = False) -> DataFrame:
    """Replace what is at the path by hash buckets of the key, sorted inside, and read them back.

    The buckets are known to the session's catalogue, so joins and groupings of such tables on the key need no shuffle.
    Rows are brought to their bucket first, one file a bucket, unless they are ``placed`` already, as the result of a
    join of tables with the same number of buckets is. The default number is that of a shuffle's parts.
    """
    spark = df.sparkSession
    n = buckets or parts(spark)
    fs, target = _fs(spark, path)
    fs.delete(target, True)
    name = f"bucketed_{uuid.uuid4().hex}"
    rows = df if placed else df.repartition(n, key)
    rows.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name).select(*df.columns)


def write_by_month(df: DataFrame, path: str, day: str, year: str, month: str) -> None:
    """Year and month columns derived from a date, then a write partitioned by them."""
    write_parquet(df.withColumns(part_columns(day, year, month)), path, [year, month])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_splits(splits: Splits, root: str) -> None:
    """``<root>/<table>/{treino,oot}`` parquet folders."""
    for table, pair in splits.items():
        for name, df in pair.items():
            write_parquet(df, f"{root.rstrip('/')}/{table}/{name}")


def read_splits(spark: SparkSession, root: str) -> Splits:
    """The saved pairs; a missing split is skipped with a warning, a missing root is an error."""
    if not exists(spark, root):
        raise FileNotFoundError(root)
    out: Splits = {}
    for table in subfolders(spark, root):
        pair = {}
        for name in (TRAIN, OOT):
            path = f"{root.rstrip('/')}/{table}/{name}"
            if exists(spark, path):
                pair[name] = spark.read.parquet(path)
            else:
                log.warning("split %s of table %s is missing", name, table)
        if pair:
            out[table] = pair
    return out


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame],
            partition_by: Sequence[str] = ()) -> None:
    """Correct a stored table in place.

    The corrected table is written completely next to the old one before the two
    folders are exchanged, so a failed job leaves the old table untouched. The partitioning
    of the stored table is kept unless another one is given.
    """
    token = uuid.uuid4().hex
    base = path.rstrip("/")
    if not partition_by:
        first = first_data_file(spark, base) or ""
        name = base.rsplit("/", 1)[-1]
        parts = first.split("/")
        below = parts[len(parts) - parts[::-1].index(name):-1] if name in parts else []
        partition_by = tuple(x.split("=", 1)[0] for x in below if "=" in x)
    staged, retired = f"{base}.new-{token}", f"{base}.old-{token}"
    write_parquet(change(spark.read.parquet(path)), staged, partition_by)
    fs, current = _fs(spark, base)
    new, old = _fs(spark, staged)[1], _fs(spark, retired)[1]
    if not fs.rename(current, old):
        raise OSError(f"cannot retire {path}")
    if not fs.rename(new, current):
        fs.rename(old, current)
        raise OSError(f"cannot publish {path}")
    fs.delete(old, True)


def correct_columns(df: DataFrame, salary: str = "SALARIO_FUNC_PUBL", amounts: Sequence[str] = (),
                    no_history: str = "SEM_HISTORICO_RECARGA") -> DataFrame:
    """Final fixes of the base table: impossible salaries and negative history amounts to 0."""
    changes = {}
    if salary in df.columns:
        changes[salary] = F.when(F.col(salary) < -1, F.lit(0)).otherwise(F.col(salary))
    for c in amounts:
        if c in df.columns:
            changes[c] = F.when((F.col(c) < 0) & (F.col(no_history) != 1), F.lit(0)).otherwise(F.col(c))
    return df.withColumns(changes) if changes else df


def write_reports(reports: Mapping[str, DataFrame], root: str) -> None:
    for name, df in reports.items():
        write_csv(df, f"{root.rstrip('/')}/{name}")


def write_final_model(models: Mapping[str, PipelineModel], path: str, step: int) -> str | None:
    """Save the last model whose key belongs to the step; returns its key."""
    keys = [k for k in models if k.startswith(f"etapa_{step}_")]
    if not keys:
        log.warning("no model of step %s", step)
        return None
    model = models[keys[-1]]
    if isinstance(model, BoostedModel):
        model.save(SparkSession.getActiveSession(), path)
    else:
        model.write().overwrite().save(path)
    return keys[-1]


def read_model(path: str) -> PipelineModel | BoostedModel:
    """A saved model of either form: pipelines have a folder of metadata."""
    spark = SparkSession.getActiveSession()
    return PipelineModel.load(path) if exists(spark, f"{path.rstrip('/')}/metadata") else BoostedModel.load(spark, path)
