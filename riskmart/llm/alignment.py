"""Cross-tokenizer alignment: token ids of two vocabularies over the same bytes, cut into groups and counted links.

Both tokenizations of a text are made in full. Byte lengths of the tokens give the offsets where both have an end; those
in front of tokens that start with a space on both sides are anchors, and cut the text into windows of a few ids. Windows
repeat like words do, so each distinct pair of id tuples is aligned once and kept in a bounded store: equal windows of a
batch are found by hash and then compared id by id. Within a window the two sequences are walked side by side; offsets
with a shared end close a group, every pair of overlapping tokens is a link.

Links are counted over the corpus by id pair. Rows read back the counts of their pairs: from a broadcast table while a
count shows it to be small; beyond that, pairs that make up a two-thousandth of all entries are broadcast (so at most 2,000)
and the others are joined by shuffle, where no key is hot any more.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import bpe, common
from riskmart.llm.common import mix, part_hashes, prefixes, staged

#: Bytes of text aligned at a time (one text at least), and bytes of alignments that one task keeps.
BATCH = 1 << 20
STORE = 64 << 20
#: A pair with this share of all (row, pair) entries counts as hot.
HOT = 1 / 2000

_B = (1 << 32) - 1


def piece_model(path: str | None = None) -> bytes:
    """Content of a piece model; by default that of the public vocabulary of 32,000 pieces with byte fallback."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def piece_bytes(piece: str) -> bytes:
    """Bytes that a piece stands for: U+2581 is a space, <0xHH> one byte."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Side:
    """One tokenizer with the bytes, byte lengths and space marks of its tokens."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t.startswith(b" ") for t in tokens])

    def ids(self, text: str, whole: bytes) -> np.ndarray | None:
        """Ids of a text, None unless their bytes are exactly a space and the text."""
        ids = self.encode(text)
        return np.array(ids, np.int64) if b"".join(map(self.tokens.__getitem__, ids)) == whole else None


@lru_cache(maxsize=2)
def sides(ranks: bytes, model: bytes) -> tuple[Side, Side]:
    import sentencepiece
    known = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, ranks.splitlines())}
    encoding = bpe._encoding(ranks)
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    return (Side(lambda text: encoding.encode_ordinary(" " + text), [known.get(i, b"") for i in range(max(known, default=-1) + 1)]),
            Side(lambda text: pieces.encode(text, num_threads=1), [piece_bytes(pieces.id_to_piece(i)) for i in range(pieces.get_piece_size())]))


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... inside each of the given counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Aligner:
    """Aligns batches of tokenized texts, with a bounded store of windows already aligned."""

    def __init__(self, a: Side, b: Side, store: int = STORE):
        self.a, self.b, self.room, self.used = a, b, store, 0
        #: by id tuples: groups as text, each closed by ";", their number, and the links as bytes
        self.known: dict[bytes, tuple[str, int, bytes]] = {}
        self.aligned = self.reused = 0
        # what is written for an id inside (first half) and at the end (second half) of its side of a group
        self.written = [np.array([f"{i}{sign}" for sign in signs for i in range(len(side.tokens))], object) for side, signs in ((a, ",|"), (b, ",;"))]

    def align(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[list[str], list[int], list[bytes]]:
        """Groups, their number and links of windows that stand one after another, n_a and n_b ids each.

        Every stretch between neighbouring ends of either side lies in one token of each, so the stretches are the links.
        """
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        marks = np.zeros(ends_a[-1] + 1, np.uint8)
        marks[ends_a] = 1
        marks[ends_b] += 2
        m = marks[np.flatnonzero(marks)]
        in_a, in_b, shared = (m & 1).astype(bool), (m & 2).astype(bool), m == 3
        at_a, at_b, group = (np.cumsum(x) - x for x in (in_a, in_b, shared))
        links = (a[at_a] << 32 | b[at_b]).tobytes()
        window = np.repeat(np.arange(len(n_a)), n_a)[at_a]
        n_links = np.bincount(window, minlength=len(n_a))
        group_a, group_b = group[in_a], group[in_b]
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = self.written[0][a + len(self.a.tokens) * shared[in_a]]
        out[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = self.written[1][b + len(self.b.tokens) * shared[in_b]]
        pieces, stops, ends = out.tolist(), np.cumsum(n_a + n_b).tolist(), (8 * np.cumsum(n_links)).tolist()
        return (["".join(pieces[s:e]) for s, e in zip([0, *stops], stops)], np.bincount(window[shared], minlength=len(n_a)).tolist(),
                [links[s:e] for s, e in zip([0, *ends], ends)])

    def found(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[tuple[str, int, bytes]]:
        """Alignments of distinct windows that stand one after another: from the store, else made together and kept."""
        both, sizes = np.empty(len(a) + len(b) + len(n_a), np.int32), n_a + n_b + 1
        starts = np.cumsum(sizes) - sizes
        both[starts] = n_a  # tells where the second side starts
        both[np.repeat(starts + 1, n_a) + _within(n_a)] = a
        both[np.repeat(starts + 1 + n_a, n_b) + _within(n_b)] = b
        buffer = both.tobytes()
        keys = [buffer[s:e] for s, e in zip((4 * starts).tolist(), (4 * (starts + sizes)).tolist())]
        out = [self.known.get(key) for key in keys]
        new = np.array([x is None for x in out])
        self.reused += len(keys) - int(new.sum())
        if new.any():
            self.aligned += int(new.sum())
            made = self.align(a[np.repeat(new, n_a)], b[np.repeat(new, n_b)], n_a[new], n_b[new])
            for i, text, n, links in zip(np.flatnonzero(new).tolist(), *made):
                out[i] = (text, n, links)
                size = len(keys[i]) + len(text) + len(links) + 400
                if size <= self.room >> 6:
                    if self.used + size > self.room:
                        self.known.clear()
                        self.used = 0
                    self.known[keys[i]] = out[i]
                    self.used += size
        return out

    def windows(self, ids: tuple[np.ndarray, np.ndarray], last: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Index behind the last token of every window, on both sides; `last` has the last token of each text."""
        ends = [np.cumsum(side.lengths[x]) for side, x in zip((self.a, self.b), ids)]
        marks = [np.zeros(ends[0][-1] + 1, bool) for _ in ends]
        for m, e in zip(marks, ends):
            m[e] = True
        shared = [np.flatnonzero(marks[1 - i][e]) for i, e in enumerate(ends)]
        anchor = np.ones(len(shared[0]), bool)
        for side, x, at in zip((self.a, self.b), ids, shared):
            anchor &= side.spaced[x[np.minimum(at + 1, len(x) - 1)]]
        anchor |= np.isin(shared[0], last[0], assume_unique=True)
        return shared[0][anchor] + 1, shared[1][anchor] + 1

    def distinct(self, ids: tuple[np.ndarray, np.ndarray], stops: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """One window of each kind and the kind of every window; equal means equal ids on both sides."""
        starts = [np.concatenate((np.zeros(1, np.int64), s[:-1])) for s in stops]
        h = [part_hashes(prefixes(x), s, e) for x, s, e in zip(ids, starts, stops)]
        both = mix(h[0] + mix(h[1] + np.uint64(1)))
        _, one, kind = np.unique(both, return_index=True, return_inverse=True)
        for x, s, e in zip(ids, starts, stops):
            n = e - s
            same = n == n[one[kind]]
            if same.all():
                same = x == x[np.repeat(s[one[kind]], n) + _within(n)]
            if not same.all():  # two windows with one hash: tell all of them apart by their ids
                seen: dict[tuple[bytes, bytes], int] = {}
                kind = np.array([seen.setdefault((ids[0][p:q].tobytes(), ids[1][r:t].tobytes()), len(seen)) for p, q, r, t in zip(
                    starts[0], stops[0], starts[1], stops[1])])
                return np.unique(kind, return_index=True)[1], kind
        return one, kind

    def batch(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
        """For each text its groups as text, their number, its distinct links and how often it has them."""
        if not pairs:
            return []
        ids = (np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]))
        last = (np.cumsum([len(a) for a, _ in pairs]) - 1, np.cumsum([len(b) for _, b in pairs]) - 1)
        stops = self.windows(ids, last)
        one, kind = self.distinct(ids, stops)
        starts = [np.concatenate((np.zeros(1, np.int64), s[:-1]))[one] for s in stops]
        each = [s[one] - b for s, b in zip(stops, starts)]
        found = self.found(*(x[np.repeat(s, n) + _within(n)] for x, s, n in zip(ids, starts, each)), *each)
        doc = np.searchsorted(last[0], stops[0] - 1)
        counts = np.array([f[1] for f in found], np.int64)
        sizes = np.array([len(f[2]) for f in found], np.int64) >> 3
        links = np.frombuffer(b"".join([f[2] for f in found]), np.int64)
        names, code = np.unique(links, return_inverse=True)
        n = sizes[kind]
        at = np.repeat((np.cumsum(sizes) - sizes)[kind], n) + _within(n)
        own, times = np.unique(np.repeat(doc, n) * len(names) + code[at], return_counts=True)
        cut = np.searchsorted(own, np.arange(len(pairs) + 1) * len(names))
        n_groups = np.bincount(doc, counts[kind], len(pairs)).astype(np.int64)
        texts = np.array([f[0] for f in found], object)[kind]
        first = np.searchsorted(doc, np.arange(len(pairs) + 1))
        return [("".join(texts[first[i]:first[i + 1]].tolist())[:-1], int(n_groups[i]), names[own[cut[i]:cut[i + 1]] % len(names)], times[cut[i]:cut[i + 1]])
                for i in range(len(pairs))]


def aligned(docs: DataFrame, ranks: bytes | None = None, model: bytes | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links of every row; `keep` may add "groups" as text.

    links is an array of (pair, n): a pair is A id << 32 | B id, n how often its tokens overlap in the text.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks or bpe.vocabulary(), model or piece_model()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    with_groups = "groups" in keep
    link = pa.struct([("pair", pa.int64()), ("n", pa.int32())])
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", *(["groups"] if with_groups else [])]
    types = [pa.int64()] * 4 + [pa.string(), pa.list_(link)] + [pa.string()] * with_groups

    def rows(aligner: Aligner, texts: list[str | None]) -> Iterator[tuple]:
        """Counts, digest, links and groups of some texts."""
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        has = []
        for text in texts:
            whole = b" " + (text or "").encode("utf-8", "surrogatepass")
            a = aligner.a.ids(text, whole) if text else None
            b = aligner.b.ids(text, whole) if a is not None else None
            has.append(b is not None)
            if b is not None:
                pairs.append((a, b))
        done = iter(zip(pairs, aligner.batch(pairs)))
        for ok in has:
            if not ok:
                yield 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64), ""
                continue
            (a, b), (groups, n, links, times) = next(done)
            yield len(a), len(b), n, int(times.sum()), hashlib.sha256(groups.encode()).hexdigest(), links, times, groups if with_groups else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*sides(*shared.value))

        def out(ids: list, texts: list) -> pa.RecordBatch:
            found = list(rows(aligner, texts))
            offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum([len(f[5]) for f in found], dtype=np.int32)))
            values = pa.StructArray.from_arrays([pa.array(np.concatenate([f[5] for f in found]), pa.int64()),
                                                 pa.array(np.concatenate([f[6] for f in found]).astype(np.int32), pa.int32())], fields=list(link))
            columns = [pa.array([f[i] for f in found], types[i]) for i in range(5)] + [pa.ListArray.from_arrays(pa.array(offsets), values).cast(types[5])]
            if with_groups:
                columns.append(pa.array([f[7] for f in found], pa.string()))
            return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", *names])

        for batch in batches:
            at, size, texts = 0, 0, []
            for text in batch.column(1):
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= BATCH:
                    yield out(batch.column(0).slice(at, len(texts)), texts)
                    at, size, texts = at + len(texts), 0, []
            if texts:
                yield out(batch.column(0).slice(at, len(texts)), texts)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, n: int>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema + ", groups string" * with_groups)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, rows, best): links of each id pair over all rows, rows that have it, whether its B id has none more frequent."""
    counts = rows.select(F.inline("links")).groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("rows"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(_B)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", "rows", (F.col("count") == F.col("most")).alias("best"))


def linked(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of every row with links; `rows` has a unique column row."""
    each = rows.select("row", F.inline("links"))
    table = counts.drop("rows")
    if counts.count() <= common.BROADCAST_ROWS:
        joined = each.join(F.broadcast(table), "pair")
    else:
        # shares of all (row, pair) entries: no more than 1 / HOT pairs can have one this large
        hot = counts.filter(F.col("rows") >= HOT * counts.agg(F.sum("rows")).first()[0])
        often = F.broadcast(hot.drop("rows"))
        rest = table.join(F.broadcast(hot.select("pair")), "pair", "leftanti")
        joined = each.join(often, "pair").unionByName(each.join(F.broadcast(hot.select("pair")), "pair", "leftanti").join(rest, "pair"))
    return joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("bigint").alias("n_best"),
                                     F.sum(F.col("n") * F.col("count")).cast("bigint").alias("count_sum"))


def op13_alignment(docs: DataFrame, ranks: bytes | None = None, model: bytes | None = None) -> DataFrame:
    """One row per document: tokens of both vocabularies, groups, links, links with the best count of their B id, sum of counts.

    Null and empty texts, and texts whose tokens in either vocabulary do not spell a space and the text, have no tokens:
    zeros and the empty digest; they count for no pair. Repeated rows count and are returned as often as they occur. An
    empty table gives no rows; other columns of the table are not read.
    """
    rows = staged(aligned(docs, ranks, model).withColumn("row", F.monotonically_increasing_id()), "align-rows", compression="zstd")
    counts = staged(pair_counts(rows), "align-counts")
    found = rows.drop("links").join(linked(rows, counts), "row", "left")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
                        F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"), "groups_sha256")
