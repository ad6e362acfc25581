"""Helpers shared by the corpus operators: staged tables, hashing of words, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.session import shared_folder

#: A byte belongs to a word unless it is one of these: space and the five control characters 9 to 13.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write the rows as Parquet below the shared folder and read them back.

    Cuts the lineage at a table that every executor can reach, so nothing above it is computed twice and a lost
    executor costs one task. The folder stays until the owner of spark.checkpoint.dir clears it.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: A join side is broadcast up to this many rows (each below 100 bytes); beyond it, the join is left to a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """The same rows, marked for broadcast if a count shows them to be few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the identifier as text, modulo n; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values so that every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 14)
        for i, base in enumerate((_BASE, _BACK)):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            _powers[i] = np.multiply.accumulate(values)
    return _powers[0], _powers[1]


def spans(a: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    edge = np.diff(np.concatenate((np.zeros(1, np.int8), (~separators[a]).view(np.int8), np.zeros(1, np.int8))))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def prefixes(a: np.ndarray) -> np.ndarray:
    """Running polynomial sums of a byte array; two of them give the hash of any part."""
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _power(len(a))[0][:len(a)], out=out[1:])
    return out


def part_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the parts [start, end), from their prefix sums."""
    return mix((sums[ends] - sums[starts]) * _power(len(sums))[1][starts])


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, its letters A-Z lowered, in order."""
    a = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(a):
        return np.empty(0, np.uint64)
    starts, ends = spans(a)
    return part_hashes(prefixes(a), starts, ends)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words; of the whole sequence when it is shorter, nothing without words."""
    n = len(words)
    if not n:
        return words
    if n < k:
        k = n
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + words[i:n - k + 1 + i]
    return mix(out + np.uint64(k))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    return np.unique(shingles(word_hashes(text), k))


#: Edges that one task contracts by itself.
EDGES = 200_000


def _contracted(edges: DataFrame, count: int) -> DataFrame:
    """Edges (node, smallest node of its component within the task), the same components in fewer and shorter paths.

    Tasks grow with the number of edges, so each holds some EDGES of them.
    """
    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                a, b = (find(parent.setdefault(x, x)) for x in (a, b))
                parent[max(a, b)] = min(a, b)
        if schema is not None:
            below = [(x, find(x)) for x in parent if parent[x] != x]
            for i in range(0, len(below), 100_000):
                columns = list(zip(*below[i:i + 100_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], names=["a", "b"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(-(-count // EDGES) or 1).mapInArrow(forest, f"a {kind}, b {kind}")


def components(edges: DataFrame, name: str, most_rounds: int = 64) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the smallest node of a component.

    Tasks first contract the edges they hold; if all fit one task, that is the result. Otherwise large-star and small-star
    steps alternate: neighbours above a node are linked to the smallest one it knows, then those below. Every round is a
    grouping with map-side combining and a join, staged in the shared folder, and ends when a round changes nothing; stars
    and chains take a logarithmic number of rounds. Nulls are left out. While the edges counted in the round before are
    few, the smallest neighbours are broadcast (there is at most one a node).
    """
    edges = staged(edges.filter("a is not null and b is not null and a <> b").select("a", "b"), f"{name}-edges")
    count = edges.count()
    edges, before = staged(_contracted(edges, count), f"{name}-forest"), None
    for i in range(most_rounds if count > EDGES else 0):
        few = F.broadcast if before is not None and 2 * before[0] <= BROADCAST_ROWS else lambda t: t
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(few(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(few(floor), "a")
        edges = staged(small.select("a", F.col("m").alias("b")).unionByName(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), f"{name}-{i}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        if count > EDGES:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
