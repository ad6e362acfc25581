"""Incremental landing of new files with Structured Streaming.

The checkpoint remembers which files have landed, so a rerun copies new ones only and
an interrupted run resumes without duplicates. No state grows with the data.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def new_files(spark: SparkSession, source: str, schema, pattern: str | None = None,
              files_per_batch: int | None = None, paths: str | None = None) -> DataFrame:
    """Unseen parquet files below ``source``; ``pattern`` keeps files by their own name, ``paths`` by their path below
    ``source``, where a path that is a folder stands for all files in it."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{source.rstrip('/')}/{paths}" if paths else source)


def _plain(name: str) -> str:
    """The name with the signs that globs give a meaning escaped."""
    return re.sub(r"([\\{}\[\],*?])", r"\\\1", name)


def name_pattern(prefixes: Sequence[str] = (), names: Sequence[str] = ()) -> str:
    """Glob that includes names or paths by prefix or exactly, duplicates removed."""
    items = dict.fromkeys([f"{_plain(p)}*" for p in prefixes] + [_plain(n) for n in names])
    if len(items) < 2:
        return next(iter(items), "*")
    return "{" + ",".join(items) + "}"


def land(stream: DataFrame, target: str, checkpoint: str | None = None,
         partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append everything that is new, then stop."""
    checkpoint = checkpoint or f"{target.rstrip('/')}/_landing_checkpoint"
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start()


def land_and_wait(spark: SparkSession, source: str, target: str, schema, checkpoint: str,
                  pattern: str | None = None, paths: str | None = None) -> None:
    query = land(new_files(spark, source, schema, pattern, paths=paths), target, checkpoint)
    query.awaitTermination()
