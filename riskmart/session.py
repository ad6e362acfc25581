"""Session factory and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import json
import logging
import shutil
import tempfile
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)
_own_folders: dict[str, str] = {}

DEFAULTS: dict[str, str] = {
    # let the optimizer size joins and shuffles from what it sees at run time
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # wide tables build thousands of expressions: do not record a call site for each
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # sentinel dates such as 1000-01-01 are stored
    "spark.sql.parquet.datetimeRebaseModeInWrite": "LEGACY",
    "spark.sql.parquet.datetimeRebaseModeInRead": "LEGACY",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session_conf(overrides: Mapping[str, object] | None = None, path: str | Path | None = None) -> dict[str, str]:
    """Defaults, then ``spark.*`` keys of a JSON file, then explicit overrides.

    A missing, malformed or non-object file leaves the defaults; other keys are ignored.
    """
    conf = dict(DEFAULTS)
    loaded: object = {}
    if path is not None:
        try:
            loaded = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, json.JSONDecodeError) as e:
            log.warning("session file %s not used: %s", path, e)
        if not isinstance(loaded, dict):
            log.warning("session file %s is not an object", path)
            loaded = {}
    for source in (loaded, overrides or {}):
        for k, v in source.items():
            if k.startswith("spark."):
                conf[k] = str(v)
            else:
                log.warning("ignored setting %s", k)
    return conf


def get_spark(app_name: str = "riskmart", overrides: Mapping[str, object] | None = None,
              path: str | Path | None = None, master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in session_conf(overrides, path).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Stored bytes of the inputs for each part of a shuffle.
PART_BYTES = 2 << 20
#: Up to this size, compressed, small parts of a large job are put together; in memory its rows take many times as much.
TOGETHER = 8 << 20


def parts(spark: SparkSession) -> int:
    """Into how many parts a shuffle deals its rows before small ones are put together."""
    return int(spark.conf.get(PARTS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def size_parts(spark: SparkSession, stored_bytes: int) -> None:
    """Let the parts of a shuffle grow with the inputs, so that a task's memory does not.

    Adaptive execution puts small parts together again, for larger inputs only up to TOGETHER; it never makes more of them
    than a shuffle has. The number of shuffle partitions is the least.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-stored_bytes // PART_BYTES)
    if wanted > least:
        spark.conf.set(PARTS, wanted)
        spark.conf.set(ADVISED, TOGETHER)
    else:
        spark.conf.unset(PARTS)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own, one for its whole life.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="riskmart-")
        atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
    return _own_folders[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet below the shared folder and read them back: columnar, reachable by every executor."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise through a reliable checkpoint, so a lost executor loses nothing."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
