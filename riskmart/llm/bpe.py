"""Byte-level BPE with chunk reuse.

A rolling hash over the last bytes cuts every text into chunks whose borders depend on content alone, so copies and
near copies share most chunks. Documents travel to the range of their smallest chunk hash, next to those they share
text with; there a chunk is encoded once and kept in a bounded store. Chunks break words, so only the part between the
first and the last safe point of a chunk is kept as token ids; the stretch around a join is encoded again over the
concatenated text, growing chunk by chunk until a safe point ends it on both sides, where both encodings agree. A safe
point is a space between two ASCII letters: every split of the text into pre-tokens has a border in front of that
space, and pre-tokens are encoded independently of each other, so the joined ids equal those of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import mix, part_hashes, prefixes

#: Fixed values of the public vocabulary: its split pattern and its only special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}

WINDOW = 32
SAFE = re.compile(rb"[A-Za-z](?= [A-Za-z])")
#: Bytes of encoded chunks that one task keeps.
STORE = 48 << 20


def vocabulary(path: str | None = None) -> bytes:
    """Content of a file of ranks; by default that of the public byte-level vocabulary of 50,257 entries."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken
    return tiktoken.Encoding("corpus", pat_str=PATTERN, special_tokens=SPECIAL, mergeable_ranks={
        base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())})


def chunk_borders(b: bytes, bits: int = 10) -> list[int]:
    """Ends of the chunks of a text: after about every 2**bits bytes, where the rolling hash of the last bytes says so."""
    n = len(b)
    if n <= WINDOW:
        return [n] if n else []
    a = np.frombuffer(b, np.uint8)
    ends = np.arange(WINDOW, n)
    h = part_hashes(prefixes(a), ends - WINDOW, ends)
    cut = ends[((h & np.uint64((1 << bits) - 1)) == 0) & ((a[WINDOW:] & 0xC0) != 0x80)]
    return [*cut.tolist(), n]


def smallest_chunk(text: str | None) -> int:
    """Smallest chunk hash of a text: documents that share text often share it. 0 for an empty text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    ends = np.array(chunk_borders(b), np.int64)
    if not len(ends):
        return 0
    sums = prefixes(np.frombuffer(b, np.uint8))
    return int(mix(part_hashes(sums, np.concatenate((np.zeros(1, np.int64), ends[:-1])), ends)).min() >> np.uint64(1))


class Encoder:
    """Encodes texts chunk by chunk, with a bounded store of chunks already encoded."""

    def __init__(self, ranks: bytes, store: int = STORE):
        self.encoding, self.room, self.used = _encoding(ranks), store, 0
        self.known: OrderedDict[bytes, tuple[int, int, bytes]] = OrderedDict()
        self.special = re.compile(b"|".join(re.escape(x.encode()) for x in SPECIAL))
        self.encoded = self.reused = 0

    def plain(self, b: bytes) -> bytes:
        return array("I", self.encoding.encode_ordinary(b.decode("utf-8"))).tobytes() if b else b""

    def chunk(self, b: bytes) -> tuple[int, int, bytes]:
        """First and last safe point of a chunk (its length where there is none) and the ids between them."""
        found = self.known.get(b)
        if found is not None:
            self.known.move_to_end(b)
            self.reused += 1
            return found
        self.encoded += 1
        n = len(b)
        first = m.end() if (m := SAFE.search(b)) else n
        last, back = first, 64
        while first < n:
            tail = [m.end() for m in SAFE.finditer(b, max(0, n - back))]
            if tail or back >= n:
                last = tail[-1] if tail else first
                break
            back *= 4
        found = (first, last, self.plain(b[first:last]))
        self.known[b] = found
        self.used += n + len(found[2]) + 200
        while self.used > self.room and self.known:
            key, gone = self.known.popitem(last=False)
            self.used -= len(key) + len(gone[2]) + 200
        return found

    def ids(self, text: str | None) -> bytes:
        """Token ids of a whole text as 32-bit little-endian integers; special tokens in it are one id."""
        b = (text or "").encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode()
        out, at = [], 0
        for m in [*self.special.finditer(b), None]:
            part = b[at:m.start() if m else len(b)]
            start, pending = 0, b""
            for end in chunk_borders(part):
                piece = part[start:end]
                start = end
                first, last, body = self.chunk(piece)
                if first == len(piece):
                    pending += piece
                    continue
                out += [self.plain(pending + piece[:first]), body]
                pending = piece[last:]
            out.append(self.plain(pending))
            if m:
                out.append(array("I", [SPECIAL[m[0].decode()]]).tobytes())
                at = m.end()
        return b"".join(out)

    def text(self, ids: bytes) -> str:
        return self.encoding.decode(array("I", ids).tolist())


def encode(docs: DataFrame, ranks: bytes | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row; `keep` may add "ids" and "decoded".

    Documents are dealt to ranges of (smallest chunk hash, text hash, row): a hot group of copies spreads over several
    ranges and is encoded once in each.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks or vocabulary())
    kind = docs.schema["doc_id"].dataType.simpleString()

    extra = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}
    more = [c for c in extra if c in keep]
    types = [pa.int64(), pa.string(), pa.string(), *(extra[c][1] for c in more)]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *more]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((smallest_chunk(x.as_py()) for x in batch.column(1)), pa.int64())],
                                             names=["doc_id", "text", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, row = Encoder(shared.value), None, None
        for batch in batches:
            found = []
            for x in batch.column(1):
                x = x.as_py()
                if x != before:
                    ids = encoder.ids(x)
                    decoded = encoder.text(ids)
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    if "ids" in keep:
                        row += (np.frombuffer(ids, "<u4").astype(np.int32),)
                    if "decoded" in keep:
                        row += (decoded,)
                    before = x
                found.append(row)
            columns = list(zip(*found)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.mapInArrow(key, f"doc_id {kind}, text string, near long").withColumn("h", F.xxhash64("text"))
    order = ["near", "h", "spread"]
    placed = keyed.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions("near", "h")
    return placed.select("doc_id", "text").mapInArrow(
        run, ", ".join([f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", *(f"{c} {extra[c][0]}" for c in more)]))


def op8_bpe(docs: DataFrame, ranks: bytes | None = None) -> DataFrame:
    """One row per document: number of tokens and digests of its ids and of the text they decode to.

    A null text counts as empty and has no tokens. Repeated rows are returned as often as they occur. Other columns of
    the table are not read.
    """
    return encode(docs, ranks)
