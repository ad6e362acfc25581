"""Sharding by a keyed Feistel permutation of global row numbers.

Rows are numbered 0 to N-1 in the order of their identifier (then of checksum and size), whatever the partitioning.
A Feistel network over a x b, the smallest near-square grid that holds N, permutes the numbers; a value that falls
outside 0..N-1 is sent through the network again until it is inside (cycle walking), which keeps the mapping one to
one. Permuted number p means shard p mod n and slot p div n, so any row's place follows from its number, N and the
seed alone, and shard sizes differ by one row at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.llm.common import mix, staged

ROUNDS = 6


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Places of the given row numbers (each in 0..n-1) under the keyed permutation of 0..n-1."""
    out = np.asarray(numbers, np.uint64).copy()
    if n < 2:
        return out
    rows = int(np.ceil(np.sqrt(n)))
    a, b = np.uint64(rows), np.uint64(-(-n // rows))
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % (1 << 64)))
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // b, out[todo] % b
        for i, key in enumerate(keys):
            if i % 2:
                right = (right + mix(left ^ key) % b) % b
            else:
                left = (left + mix(right ^ key) % a) % a
        out[todo] = left * b + right
        todo = todo[out[todo] >= np.uint64(n)]
    return out


def numbered(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Global row numbers from 0 in the given order, without a single-task window.

    Range partitions are sorted and stored; only one count for each partition reaches the driver. Rows that tie in
    all of the order columns are spread over tasks by their place in the input, so a run of equal rows is split too.
    """
    stored = staged(df.withColumn("__spread", F.monotonically_increasing_id()), "shard-in", compression="zstd")
    keys = [*order, "__spread"]
    ranged = staged(stored.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__spread")
                    .withColumn("__part", F.spark_partition_id())
                    .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "shard-sorted", compression="zstd")
    start, offsets = 0, []
    for part, n in sorted(tuple(r) for r in ranged.groupBy("__part").count().collect()):
        offsets.append((part, start))
        start += n
    spark = df.sparkSession
    known = spark.createDataFrame(offsets or [(0, 0)], "__part int, __start long")
    return ranged.join(F.broadcast(known), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def feistel_shards(df: DataFrame, order: list[str], n_shards: int, seed: int = 0) -> DataFrame:
    """All rows of df with row_no, shard and slot; shards hold floor or ceil of N / n_shards rows.

    Null order values sort first; equal rows get numbers of their own. An empty table gives no rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    rows = numbered(df, order)
    n = rows.count()
    schema = rows.schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = permute(batch.column(batch.schema.get_field_index("row_no")).to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((p % np.uint64(n_shards)).astype(np.int32)), pa.array((p // np.uint64(n_shards)).astype(np.int64))],
                names=[*batch.schema.names, "shard", "slot"])

    return rows.mapInArrow(place, T.StructType([*schema, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))


def sharded(docs: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """Every row of docs, whole in the column `document`, with doc_id, shard and slot under the `rows` law."""
    text = F.col("text").cast("binary")
    rows = docs.select("doc_id", F.crc32(F.coalesce(text, F.lit(b""))).alias("__crc"), F.coalesce(F.octet_length(text), F.lit(0)).alias("__bytes"),
                       F.struct(*docs.columns).alias("document"))
    return feistel_shards(rows, ["doc_id", "__crc", "__bytes"], n_shards, seed).select("doc_id", "document", "shard", "slot")


def op10_sharding(docs: DataFrame, n_shards: int = 24, seed: int = 20) -> DataFrame:
    """One row per document: its size, checksum, shard and slot under the `rows` law.

    A null text has 0 bytes and the checksum 0. Repeated rows are numbered one after another. `grown_shard` is null:
    under this law a further shard moves most rows. Whole documents are placed; size and checksum are those of the text placed.
    """
    text = F.col("document.text").cast("binary")
    return sharded(docs, n_shards, seed).select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
