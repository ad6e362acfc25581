"""Removal of repeated passages by sparse suffix arrays.

A passage is PASSAGE or more consecutive words. Of the suffixes of all texts only those are kept that start at a
minimiser: the smallest hash of SEED consecutive words among all seeds of some PASSAGE words. Equal passages select the
same place, so a passage that occurs twice has a kept suffix in both places. Kept suffixes whose seed occurs in several
documents are sorted by the words that follow; neighbours are compared for their common length, and matches are extended
to the left over the words before the seed. A passage belongs to the first document that has it (smallest identifier, then
text hash); the words it covers in any later document are repeated. All windows of PASSAGE words are decided exactly.

Documents with equal texts are settled beforehand: all but the first are repeated as a whole. Suffixes with a seed that
occurs very often are not brought together; their windows are hashed and each takes the first document by a grouped
minimum with map-side combining.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import SPACES, mix, shingles, small, spans, staged, word_hashes

PASSAGE, SEED = 50, 16
#: Seeds with more occurrences than this (about 400 bytes each) are decided window by window instead of side by side in a task.
HOT = 50_000
#: Up to this many shared seeds are looked up while texts are read (8 bytes each); beyond it all suffixes are joined.
LOOKUP = 4_000_000
_LAST = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def seeds(words: np.ndarray, passage: int = PASSAGE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the minimisers of a text; none if it is shorter than a passage."""
    if len(words) < passage:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    k = shingles(words, seed)
    width = passage - seed + 1
    least = np.lib.stride_tricks.sliding_window_view(k, width).argmin(axis=1) + np.arange(len(k) - width + 1)
    places = np.unique(least)
    return places, k[places]


def _identified(docs: DataFrame) -> DataFrame:
    """docs with __o, the place of its identifier in the order of documents, and __d, a hash of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"__o": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)),
                             "__d": F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")})


def _outline(docs: DataFrame, passage: int, seed: int) -> DataFrame:
    """(o, d, n, seeds) for every row."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(2):
                words = word_hashes(text.as_py())
                sizes.append(len(words))
                found.append(seeds(words, passage, seed)[1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                                             names=["o", "d", "n", "seeds"])

    rows = docs.select("__o", "__d", F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(read, "o long, d long, n long, seeds array<long>"), "suffix-outline")


def _suffixes(texts: DataFrame, shared: DataFrame, hot: DataFrame, passage: int, seed: int) -> DataFrame:
    """Suffixes at shared seeds: with the words around them (hot false), or one row for each window (hot true)."""
    spark = texts.sparkSession

    def numbers(df: DataFrame) -> np.ndarray:
        return np.sort(df.toPandas()["seed"].to_numpy(np.int64))

    known = spark.sparkContext.broadcast(numbers(shared)) if shared.count() <= LOOKUP else None
    often = spark.sparkContext.broadcast(numbers(hot))
    before = passage - seed

    def inside(values: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(values), bool)
        at = np.searchsorted(table, values)
        at[at == len(table)] = 0
        return table[at] == values

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seed", "right", "left", "o", "d", "pos"]
        for batch in batches:
            out = [[] for _ in names]
            for o, d, text in zip(*(batch.column(i) for i in range(3))):
                words = word_hashes(text.as_py())
                places, found = seeds(words, passage, seed)
                if not len(places):
                    continue
                found = found.view(np.int64)
                some = inside(found, known.value) if known is not None else np.ones(len(found), bool)
                if not some.any():
                    continue
                o, d, n = o.as_py(), d.as_py(), len(words)
                crowded = inside(found, often.value)
                short = words.astype(np.uint32).astype(">u4")
                if (some & crowded).any():
                    # each window around a crowded seed once, however many such seeds it holds
                    due = np.zeros(n, bool)
                    for p in places[some & crowded].tolist():
                        due[max(0, p - before):min(p, n - passage) + 1] = True
                    starts = np.flatnonzero(due)
                    for start, window in zip(starts.tolist(), shingles(words, passage).view(np.int64)[starts].tolist()):
                        for column, value in zip(out, (window, None, None, o, d, start)):
                            column.append(value)
                for p, s, many in zip(places[some].tolist(), found[some].tolist(), crowded[some].tolist()):
                    if not many:
                        for column, value in zip(out, (s, short[p:p + passage].tobytes(), short[max(0, p - before):p].tobytes(), o, d, p)):
                            column.append(value)
            types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    rows = texts.select("__o", "__d", F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(read, "seed long, right binary, left binary, o long, d long, pos long").distinct()
    if known is None:
        found = found.filter("right is not null").join(shared, "seed", "leftsemi").union(found.filter("right is null"))
    return staged(found, "suffix-kept")


def _matrix(column: pa.Array, width: int, from_end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of binary values as rows of a matrix, filled with 0, and their numbers."""
    values = column.to_pylist()
    sizes = np.array([len(v) // 4 for v in values], np.int64)
    filled = b"".join(v.rjust(4 * width, b"\0") if from_end else v.ljust(4 * width, b"\0") for v in values)
    return np.frombuffer(filled, ">u4").reshape(len(values), width).astype(np.uint64), sizes


def repeated_windows(seed: np.ndarray, right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray,
                     rank: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes sorted by (seed, words to the right): the least and the largest number of words left of the seed
    with which a window of `passage` words starts that an earlier document (smaller rank) has as well; -1 if none."""
    n, before = len(seed), left.shape[1]
    low, high = np.full(n, -1), np.full(n, -1)
    if n < 2:
        return low, high
    equal = right[1:] == right[:-1]
    common = np.where(equal.all(axis=1), passage, equal.argmin(axis=1))
    common = np.concatenate((np.zeros(1, np.int64), np.where(seed[1:] == seed[:-1], common, -1)))
    back = np.zeros(n, np.uint64)
    by_rank = np.argsort(rank, kind="stable")
    for j in range(before + 1):
        if j:
            back = back * _ODD + left[:, before - j] + np.uint64(1)
        run = np.cumsum(common < passage - j).astype(np.uint64)
        some = by_rank[((n_left >= j) & (n_right >= passage - j))[by_rank]]
        kind = mix(run * _ODD ^ mix(back))[some]
        order = np.argsort(kind, kind="stable")
        some, kind = some[order], kind[order]
        if len(some) < 2:
            continue
        head = np.concatenate((np.ones(1, bool), kind[1:] != kind[:-1]))
        first = rank[some][np.maximum.accumulate(np.where(head, np.arange(len(some)), 0))]
        late = some[rank[some] > first]
        high[late] = j
        low[late] = np.where(low[late] < 0, j, low[late])
    return low, high


def _intervals(kept: DataFrame, passage: int, seed: int) -> DataFrame:
    """(o, d, a, b): words a to b-1 of a document repeat a passage of an earlier one."""
    before = passage - seed

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def decide(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            o, d, pos, s = (table.column(c).to_numpy() for c in ("o", "d", "pos", "seed"))
            right, n_right = _matrix(table.column("right"), passage, False)
            left, n_left = _matrix(table.column("left"), before, True)
            order = np.lexsort((d, o))
            new = np.concatenate((np.zeros(1, bool), (o[order][1:] != o[order][:-1]) | (d[order][1:] != d[order][:-1]))) if len(o) else np.zeros(0, bool)
            rank = np.empty(len(o), np.int64)
            rank[order] = np.cumsum(new)
            low, high = repeated_windows(s, right, n_right, left, n_left, rank, passage)
            some = high >= 0
            return pa.RecordBatch.from_arrays([pa.array(o[some]), pa.array(d[some]), pa.array(pos[some] - high[some]),
                                               pa.array(pos[some] - low[some] + passage)], names=["o", "d", "a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            s = table.column("seed").to_numpy()
            if not len(s):
                continue
            whole = int(np.flatnonzero(s != s[-1])[-1]) + 1 if (s != s[-1]).any() else 0
            held = table.slice(whole)
            if whole:
                yield decide(table.slice(0, whole))
        if held is not None and held.num_rows:
            yield decide(held)

    near = kept.filter("right is not null").repartition("seed").sortWithinPartitions("seed", "right").mapInArrow(compare, "o long, d long, a long, b long")
    windows = kept.filter("right is null").select(F.col("seed").alias("window"), "o", "d", "pos")
    first = windows.groupBy("window").agg(F.min("o").alias("first"))
    tied = windows.join(first, "window").filter("o = first").groupBy("window").agg(F.min("d").alias("first_d"))
    far = windows.join(first, "window").join(tied, "window").filter("o > first or d > first_d").select(
        "o", "d", F.col("pos").alias("a"), (F.col("pos") + passage).alias("b"))
    return near.union(far)


def repeats(docs: DataFrame, passage: int = PASSAGE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Outline rows (o, d, n) of all rows, and (o, d, spans) with the repeated stretches of words, merged and in order."""
    if not 1 <= seed <= passage:
        raise ValueError("a seed must fit into a passage")
    own = _identified(docs)
    outline = _outline(own, passage, seed)
    first = outline.groupBy("d").agg(F.min("o").alias("first"))
    copies = staged(outline.join(first, "d").filter("o > first").select("o", "d", "n").distinct(), "suffix-copies")
    out = small(copies.select("o", "d"))
    found = outline.join(out, ["o", "d"], "leftanti").select("d", F.explode("seeds").alias("seed"))
    counts = staged(found.groupBy("seed").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).filter("low <> high").select(
        "seed", "n"), "suffix-shared")
    texts = own.join(out.select(F.col("o").alias("__o"), F.col("d").alias("__d")), ["__o", "__d"], "leftanti")
    kept = _suffixes(texts, counts.select("seed"), counts.filter(F.col("n") > HOT).select("seed"), passage, seed)
    parts = _intervals(kept, passage, seed).union(copies.filter(F.col("n") >= passage).select("o", "d", F.lit(0).cast("long"), "n"))
    merged = F.aggregate(F.array_sort(F.collect_set(F.struct("a", "b"))), F.array().cast("array<struct<a:bigint,b:bigint>>"), lambda done, x: F.when(
        (F.size(done) > 0) & (F.element_at(done, F.greatest(F.size(done), F.lit(1)))["b"] >= x["a"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, F.greatest(F.size(done), F.lit(1)))["a"].alias("a"),
            F.greatest(F.element_at(done, F.greatest(F.size(done), F.lit(1)))["b"], x["b"]).alias("b"))))).otherwise(F.concat(done, F.array(x))))
    return outline.select("o", "d", "n"), staged(parts.groupBy("o", "d").agg(merged.alias("spans")), "suffix-spans")


def op9_suffix_dedup(docs: DataFrame, passage: int = PASSAGE, seed: int = SEED) -> DataFrame:
    """One row per document: words, words that repeat a passage of an earlier document, and where (start, end in words).

    Words are split at ASCII white space, A-Z lowered. Null, empty and short texts repeat nothing. Rows with the same
    identifier and text are one document; null identifiers come last. Passages repeated inside one document only are left.
    """
    outline, found = repeats(docs, passage, seed)
    ids = _identified(docs.select("doc_id", "text")).select("doc_id", "__o", "__d")
    sizes = outline.groupBy("o", "d").agg(F.max("n").alias("n_words"))
    spans_of = F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>"))
    return ids.join(sizes, (F.col("__o") == sizes["o"]) & (F.col("__d") == sizes["d"])).drop("o", "d").join(
        found, (F.col("__o") == found["o"]) & (F.col("__d") == found["d"]), "left").select(
        "doc_id", "n_words", F.aggregate(spans_of, F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]).alias("n_repeated"),
        F.transform(spans_of, lambda s: F.struct(s["a"].alias("start"), s["b"].alias("end"))).alias("spans"))


def cut(text: str, found: list[tuple[int, int]]) -> str:
    """The text without the given stretches of words; the white space in front of what follows goes with them."""
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends = spans(np.frombuffer(raw, np.uint8), SPACES)
    out, at = [], 0
    for a, b in found:
        out.append(raw[at:starts[a]])
        at = int(starts[b]) if b < len(starts) else int(ends[-1])
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, passage: int = PASSAGE, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns; texts lose the passages an earlier document has, and n_chars (if there) follows."""
    _, found = repeats(docs, passage, seed)
    narrow = found.agg(F.sum(F.size("spans"))).first()[0] or 0
    found = found.select(F.col("o").alias("__o"), F.col("d").alias("__d"), F.col("spans").alias("__spans"))
    joined = _identified(docs).join(F.broadcast(found) if narrow <= 400_000 else found, ["__o", "__d"], "left")
    kind = joined.select("text").schema["text"].dataType

    @F.pandas_udf("string")
    def trimmed(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([cut(t, [(s["a"], s["b"]) for s in c]) for t, c in zip(texts, cuts)], dtype=object)

    touched = F.col("__spans").isNotNull()
    changed = joined.filter(touched).withColumn("text", trimmed(F.col("text").cast("string"), "__spans").cast(kind))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.filter(~touched).select(*docs.columns).union(changed.select(*docs.columns))
