"""SimHash fingerprints and search within a Hamming radius.

Terms are the words of a text and its pairs of neighbouring words. Each distinct term has a 64-bit hash and a weight
(square root of its count; words also in proportion to their length, as short words say little); every hash bit votes
with that weight, and the fingerprint keeps the signs. Permuted block tables answer a radius search without loss: the
64 bits are cut into blocks, and two fingerprints within radius r agree on at least (blocks - r) of them, so one
table for each choice of (blocks - r) blocks, keyed by these bits, contains every answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import SPACES, part_hashes, prefixes, shingles, spans, staged

BITS = 64
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(float)


def simhash(text: str | None) -> int:
    """Fingerprint of a whole text; 0 for a null, empty or blank one."""
    a = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(a):
        return 0
    starts, ends = spans(a, SPACES)
    if not len(starts):
        return 0
    words = part_hashes(prefixes(a), starts, ends)
    terms, first, count = np.unique(words, return_index=True, return_counts=True)
    weight = np.sqrt(count) * np.minimum(ends - starts, 16)[first] / 8
    if len(words) > 1:
        pairs, n = np.unique(shingles(words, 2), return_counts=True)
        terms, weight = np.concatenate((terms, pairs)), np.concatenate((weight, np.sqrt(n)))
    half = weight.sum() / 2
    lanes = terms.view(np.uint8).reshape(-1, 8)
    out = 0
    for lane in range(8):
        votes = np.bincount(lanes[:, lane], weights=weight, minlength=256) @ _BYTE_BITS
        for bit in np.flatnonzero(votes > half):
            out |= 1 << (8 * lane + int(bit))
    return out


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / BITS


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within(queries: DataFrame, fingerprints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (query, found) of distinct 64-bit fingerprints (column `fp`, long) at most `radius` bits apart, all of them.

    Both inputs are reduced to distinct values first, so copies never multiply. Equal pairs are returned too.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be below the number of blocks")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        mask = 0
        for i in kept:
            mask |= ((1 << (edges[i + 1] - edges[i])) - 1) << edges[i]
        masks.append(_signed(mask))

    def tables(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("fp").alias(name)).filter(F.col(name).isNotNull()).distinct().select(
            name, F.posexplode(F.array(*(F.col(name).bitwiseAND(F.lit(m)) for m in masks))).alias("table", "key"))

    return tables(queries, "query").join(tables(fingerprints, "found"), ["table", "key"]).filter(
        F.bit_count(F.col("query").bitwiseXOR(F.col("found"))) <= radius).select("query", "found").distinct()


def _edited(own: str, following: str) -> str:
    half = len(own) // 2
    return own[:len(own) - half] + following[:half]


_ROWS = "n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long, kind int, part int, text string"
_WHOLE, _TAIL, _HEAD = 0, 1, 2


def _result(own: str, fp: int, following: str, next_fp: int) -> tuple:
    edited = _edited(own, following)
    return (len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _signed(fp),
            _signed(simhash(edited)), _signed(next_fp))


def _with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form and of the document that follows in descending order.

    Texts are shuffled once, into sorted ranges. Inside a range the next row is at hand; the last row of a range is
    completed afterwards with a copy of the first row of the next one, so only two texts of each range move again and
    only the numbers of the ranges reach the driver.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    order = [F.desc_nulls_last("doc_id"), F.desc("h"), F.desc("spread")]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn(
        "h", F.xxhash64("text")).withColumn("spread", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    names = ["doc_id", *(x.split()[0] for x in _ROWS.split(", "))]
    schema = f"doc_id {kind.simpleString()}, {_ROWS}"

    def arrow(found: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(names)
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        before, id_type = None, None
        for batch in batches:
            id_type, found = batch.schema.field(0).type, []
            for i, t in zip(batch.column(0), batch.column(1)):
                i, t = i.as_py(), t.as_py()
                fp = before[2] if before and before[1] == t else simhash(t)
                if before is None:
                    found.append((i, None, None, _signed(fp), None, None, _HEAD, part, t))
                else:
                    found.append((before[0], *_result(before[1], before[2], t, fp), _WHOLE, part, None))
                before = (i, t, fp)
            yield arrow(found, id_type)
        if before is not None:
            yield arrow([(before[0], None, None, _signed(before[2]), None, None, _TAIL, part, before[1])], id_type)

    stored = staged(ranged.mapInArrow(walk, schema), "simhash")
    parts = sorted(r[0] for r in stored.filter(F.col("kind") == _HEAD).select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    heads = stored.filter(F.col("kind") == _HEAD).select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("fp").alias("first_fp"))
    ends = stored.filter(F.col("kind") == _TAIL).select("doc_id", "part", "text", "fp").join(F.broadcast(follows), "part").join(heads, "after").select(
        "doc_id", "text", "fp", "next_text", "first_fp")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *_result(t, fp % (1 << 64), n, first % (1 << 64)), _WHOLE, None, None)
                     for i, t, fp, n, first in zip(*(c.to_pylist() for c in batch.columns))]
            yield arrow(found, batch.schema.field(0).type)

    return stored.filter(F.col("kind") == _WHOLE).unionByName(ends.mapInArrow(finish, schema)).drop("kind", "part", "text")


def op6_fingerprints(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row per document: fingerprint of its text and of its edited text, with their likeness.

    The next document is the one with the next smaller identifier, after the last the first; rows that share an
    identifier follow each other by a hash of their text, null identifiers come last, and a single row follows itself.
    A null text counts as empty and has the fingerprint of 64 zero bits. `n_near`, for documents whose identifier is
    divisible by 100, counts the other documents with a fingerprint at most `radius` bits away, by the block tables over
    all rows; it is null for the rest.
    """
    rows = staged(_with_next(docs), "simhash-rows")
    counts = rows.groupBy("fp").agg(F.count("*").alias("copies"))
    asked = rows.filter(F.col("doc_id") % 100 == 0).select("fp")
    near = within(asked, counts.select("fp"), radius).join(counts.withColumnRenamed("fp", "found"), "found").groupBy("query").agg(
        (F.sum("copies") - 1).alias("near"))
    same = F.bit_count(F.col("fp").bitwiseXOR(F.col("edited_fp"))), F.bit_count(F.col("fp").bitwiseXOR(F.col("next_fp")))
    return rows.join(near, F.col("fp") == F.col("query"), "left").select(
        "doc_id", "n_chars", "edited_sha256", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.lpad(F.lower(F.hex("edited_fp")), 16, "0").alias("edited_fingerprint"),
        (1 - same[0] / BITS).alias("near_edited"), (1 - same[1] / BITS).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.col("near")).alias("n_near"))
