"""Parquet, CSV and folder-as-table readers.

Listing goes through the Hadoop file system of the path, so local and object-store
folders behave alike; reading is left to Spark's own file sources.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from riskmart.sources.naming import safe_key, table_key, unique_key

log = logging.getLogger(__name__)
EXTENSIONS = ("parquet", "csv")


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | None = None,
             infer: bool = True) -> DataFrame:
    """CSV with a header; an explicit schema avoids the extra inference job."""
    reader = spark.read.options(sep=sep, header=header)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", infer)
    return reader.csv(path)


def read_csvs(spark: SparkSession, paths: Mapping[str, str], **options) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Several CSV tables; one that cannot be read is skipped and reported."""
    tables, failed = {}, {}
    for name, path in paths.items():
        try:
            tables[name] = read_csv(spark, path, **options)
        except AnalysisException as e:
            failed[name] = str(e).splitlines()[0]
            log.warning("%s skipped: %s", name, failed[name])
    return tables, failed


def register(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


# --- listing -----------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files at the path."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def data_files(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS) -> list[str]:
    """Data files below a folder, sorted; hidden and marker files are left out."""
    fs, p = _fs(spark, path)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next().getPath()
        name = f.getName()
        if name[0] not in "._" and name.rsplit(".", 1)[-1].lower() in extensions:
            found.append(f.toString())
    return sorted(found)


def first_data_file(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS) -> str | None:
    """The first data file below a folder in path order, without listing the rest."""
    fs, p = _fs(spark, path)
    waiting = [p]
    while waiting:
        at = waiting.pop()
        if at is not p and not fs.getFileStatus(at).isDirectory():
            if at.getName().rsplit(".", 1)[-1].lower() in extensions:
                return at.toString()
            continue
        found = [(s.getPath().getName() + "/" * bool(s.isDirectory()), s.getPath()) for s in fs.listStatus(at)]
        waiting += [q for name, q in sorted(found, key=lambda x: x[0], reverse=True) if name[0] not in "._"]
    return None


class EmptyFolder(ValueError):
    """A folder without any supported data file."""


def read_folder(spark: SparkSession, folder: str, sep: str = ",", header: bool = True, infer: bool = True) -> DataFrame:
    """A folder as one table; the first file (in name order) decides the format."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    first = first_data_file(spark, folder)
    if first is None:
        raise EmptyFolder(f"no {' or '.join(EXTENSIONS)} file in {folder}")
    kind = first.rsplit(".", 1)[-1]
    fmt = kind.lower()
    reader = spark.read.format(fmt).option("pathGlobFilter", f"*.{kind}")
    partitioned = any("=" in part for part in first[len(folder):].split("/"))
    if partitioned:
        reader = reader.option("basePath", folder)
    else:
        reader = reader.option("recursiveFileLookup", True)
    if fmt == "csv":
        reader = reader.options(sep=sep, header=header, inferSchema=infer)
    return reader.load(folder)


def read_all(spark: SparkSession, root: str, **options) -> dict[str, DataFrame]:
    """Every subfolder as a table under its canonical key.

    A missing root gives no tables, an empty folder is skipped with a warning, any
    other error is raised. Nothing is counted: reading stays lazy.
    """
    tables: dict[str, DataFrame] = {}
    if not exists(spark, root):
        log.warning("folder %s does not exist", root)
        return tables
    for name in subfolders(spark, root):
        try:
            df = read_folder(spark, f"{root.rstrip('/')}/{name}", **options)
        except EmptyFolder as e:
            log.warning("%s", e)
            continue
        tables[unique_key(table_key(name), tables)] = df
    return tables


def read_files(spark: SparkSession, paths: Sequence[str]) -> dict[str, DataFrame]:
    """Parquet files or folders as tables named after them."""
    tables: dict[str, DataFrame] = {}
    for p in paths:
        tables[unique_key(safe_key(p), tables)] = read_parquet(spark, p)
    return tables
