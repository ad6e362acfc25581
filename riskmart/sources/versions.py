"""Tables published as versions: a reader finds a whole table at any moment, also while a correction runs.

Below the root lie ``data/<token>``, one folder a version that is never changed, and ``log/<number>``, one small entry a
version that names its folder and partition columns. A version exists once its entry has appeared, complete, under a number
that no other writer took. No data folder is ever renamed or written twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from riskmart.sources.readers import _fs
from riskmart.sources.writers import write_parquet


class VersionConflict(RuntimeError):
    """Another writer published in the meantime; the table is unchanged by this one."""


@dataclass(frozen=True)
class Version:
    number: int
    path: str
    partition_by: tuple[str, ...]


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _fs(spark, f"{root}/log")
    if not fs.exists(folder):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(folder))
    return sorted(int(n) for n in names if n.isdigit())


def _entry(root: str, number: int) -> str:
    return f"{root}/log/{number:012d}"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that can be read, oldest first."""
    return _numbers(spark, root.rstrip("/"))


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The version of that number, without one the latest."""
    root = root.rstrip("/")
    known = _numbers(spark, root)
    if not known or number is not None and number not in known:
        raise FileNotFoundError(f"{root}: no version{'' if number is None else f' {number}'}")
    number = known[-1] if number is None else number
    entry = json.loads(spark.read.text(_entry(root, number), wholetext=True).first()[0])
    return Version(number, f"{root}/data/{entry['folder']}", tuple(entry["partition_by"]))


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The table as of one version; it stays the same until that version expires, whatever is published."""
    return spark.read.parquet(version(spark, root, number).path)


def _announce(spark: SparkSession, root: str, number: int, folder: str, partition_by: Sequence[str]) -> None:
    fs, log = _fs(spark, f"{root}/log")
    fs.mkdirs(log)
    jvm = spark.sparkContext._jvm
    made, target = jvm.org.apache.hadoop.fs.Path(f"{root}/log/new-{folder}"), jvm.org.apache.hadoop.fs.Path(_entry(root, number))
    out = fs.create(made, False)
    try:
        out.write(bytearray(json.dumps({"folder": folder, "partition_by": list(partition_by)}).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(log).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(made), fs.makeQualified(target), never)
    except Py4JJavaError as e:
        fs.delete(made, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise VersionConflict(f"{root}: version {number} is taken") from None
        raise


def publish(df: DataFrame, root: str, partition_by: Sequence[str] = (), after: int | None = None) -> int:
    """Write df as the version that follows ``after`` (the latest, if not given) and return its number.

    A job that fails, or finds the number taken, removes what it wrote and leaves every version as it was.
    """
    root, spark, folder = root.rstrip("/"), df.sparkSession, uuid.uuid4().hex
    number = (max(_numbers(spark, root), default=0) if after is None else after) + 1
    try:
        write_parquet(df, f"{root}/data/{folder}", partition_by)
        _announce(spark, root, number, folder, partition_by)
    except Exception:
        fs, written = _fs(spark, f"{root}/data/{folder}")
        fs.delete(written, True)
        raise
    return number


def correct(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], partition_by: Sequence[str] = ()) -> int:
    """Publish the changed table after the version it was read from; VersionConflict if another one came first.

    The partitioning of the version read is kept unless another one is given.
    """
    base = version(spark, root)
    return publish(change(spark.read.parquet(base.path)), root, partition_by or base.partition_by, base.number)


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Remove all but the last ``keep`` versions, the entry before its data, and return their numbers.

    Keep as many as running readers may still use.
    """
    if keep < 1:
        raise ValueError("the latest version cannot expire")
    root = root.rstrip("/")
    gone = _numbers(spark, root)[:-keep]
    for number in gone:
        old = version(spark, root, number)
        fs, entry = _fs(spark, _entry(root, number))
        fs.delete(entry, False)
        fs.delete(_fs(spark, old.path)[1], True)
    return gone
