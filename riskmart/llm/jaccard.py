"""N-gram Jaccard join by grouped prefixes.

Each text becomes its set of shingle hashes, in the order of the hash. Two sets of a Jaccard similarity of at least t share
k tokens among their first n - ceil(t n) + k, so only these prefixes are compared. How many sets have a token in their
prefix is counted exactly; a set with too few tokens that another prefix has, too, has no partner and leaves. The others
are found by their rarest shared tokens, so many that a pair still has one in common. Equal sets are one, and sets with the
same size and prefix form one group that is filtered as a whole: by size, and by what the places of a shared token leave
for the overlap. Group pairs that pass are expanded to their members, and members are verified on whole sets. Sets also show the parities of 256 hash buckets. Two of them differ in at least as many
tokens as parities, so most pairs without a chance leave inside the join on a token, before they become rows.

Links are needed for connected components, so pairs within a component already known are not compared again, and no token
is expanded to all its pairs. Sets that share a token are first held against the one of them that shares most tokens (a
star), then components are formed. Tokens whose sets lie in several components go on: sets of their smallest components
are the next hubs, all others of the token are held against them, hubs leave, components are formed again, until each
token is left with one component. Hubs grow eightfold a round, so rounds grow with the logarithm of a list. Every pair that
passes the filters is thus verified or already connected by verified links, in any group size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmart.llm.common import components, shingle_set, small, staged

#: A prefix holds this part more of the tokens that one shared token needs, so that several must be shared.
EXTRA = 3
#: Hubs a token in the first round after the star; each further round takes eight times as many.
HUBS = 16
#: Hash buckets of a signature: how many tokens of a set fall into each bounds the overlap of two sets from above.
SIGNATURE = 128
#: Parities of hash buckets, 64 in each of these columns.
PARITY = ["w0", "w1", "w2", "w3"]
#: Up to this many needed sets are looked up while texts are read (8 bytes each); beyond it all sets go to the join.
LOOKUP = 4_000_000


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signature(values: np.ndarray) -> bytes:
    return np.minimum(np.bincount((values & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE), 65535).astype(np.uint16).tobytes()


def parities(values: np.ndarray) -> list[int]:
    """Whether each of 256 hash buckets holds an odd number of the tokens, as four signed 64-bit integers."""
    odd = np.bincount(((values >> np.uint64(7)) & np.uint64(64 * len(PARITY) - 1)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def common(n: int, num: int, den: int) -> int:
    """How many tokens of their prefixes two sets share at similarity num/den if neither has fewer than n tokens."""
    least = -(-num * n // den)
    return min(1 + (n - least + 1) // EXTRA, least)


def prefix_length(n: int, num: int, den: int) -> int:
    """How many of its n tokens a set must show for that."""
    return n - -(-num * n // den) + common(n, num, den) if n else 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Rows (doc_id, h, n, digest, g, need, prefix, sig, w0 ..): g names the sets of this size and prefix, need is how
    many tokens of the prefix any partner has in its own."""
    rows = _texts(docs).select("doc_id", F.xxhash64("text").alias("h"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), *(pa.int64() for _ in PARITY))
        for batch in batches:
            out = []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), k)
                n = len(s)
                first = s[:prefix_length(n, num, den)]
                group = hashlib.blake2b(first.tobytes() + str(n).encode(), digest_size=16).digest()
                # no partner has fewer than ceil(t n) tokens
                out.append((n, digest(s), group, common(-(-num * n // den), num, den), first.view(np.int64), signature(s) if n else b"",
                            *parities(s)))
            columns = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))],
                                             names=["doc_id", "h", "n", "digest", "g", "need", "prefix", "sig", *PARITY])

    shape = f"doc_id {kind}, h long, n long, digest binary, g binary, need long, prefix array<long>, sig binary, " + ", ".join(f"{w} long" for w in PARITY)
    return staged(rows.mapInArrow(read, shape), "join-sets", compression="zstd")


def _possible(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) whose signatures leave room for a similarity of num/den."""
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SIGNATURE).astype(np.int64) for i in (2, 3))
            most, total = np.minimum(x, y).sum(axis=1), x.sum(axis=1) + y.sum(axis=1)
            full = ((x == 65535) & (y == 65535)).any(axis=1)
            yield batch.select([0, 1]).filter(pa.array((den * most >= num * (total - most)) | full))

    sigs = members.select("digest", "sig")
    both = pairs.select("a", "b").distinct().join(sigs.select(F.col("digest").alias("a"), F.col("sig").alias("x")), "a").join(
        sigs.select(F.col("digest").alias("b"), F.col("sig").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(bound, "a binary, b binary")


def _items(need: DataFrame, docs: DataFrame, k: int, name: str) -> DataFrame:
    """(digest, items): the whole sets of the digests in need."""
    need, wanted = staged(need.distinct(), f"{name}-need"), None
    if need.count() <= LOOKUP:
        heads = need.select(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long").alias("x")).toPandas()["x"].to_numpy(np.int64)
        wanted = docs.sparkSession.sparkContext.broadcast(np.unique(heads))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0):
                s = shingle_set(text.as_py(), k)
                d = digest(s)
                if wanted is not None:
                    head = int.from_bytes(d[:7], "big")
                    at = np.searchsorted(wanted.value, head)
                    if at == len(wanted.value) or wanted.value[at] != head:
                        continue
                out.append((d, s.tobytes()))
            columns = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["digest", "items"])

    sets = _texts(docs).select("text").mapInArrow(read, "digest binary, items binary").dropDuplicates(["digest"])
    if wanted is None:
        sets = sets.join(need, "digest", "leftsemi")
    return staged(sets, f"{name}-items")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """The pairs (a, b) of set digests whose whole sets have a Jaccard similarity of at least num/den."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(den * same >= num * (len(both) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # few pairs go to the sets, so that no others move
    pairs, ends = small(pairs), small(staged(pairs.select(F.col("b").alias("digest")).distinct(), f"{name}-ends"))
    left = pairs.join(sets.select(F.col("digest").alias("a"), F.col("items").alias("x")), "a")
    sets = sets.join(ends, "digest", "leftsemi")
    both = left.join(sets.select(F.col("digest").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    return staged(both.mapInArrow(compare, "a binary, b binary"), f"{name}-links")


def _fits(x: str, y: str, num: int, den: int) -> Column:
    """Sizes near enough, and room for the shared tokens of the prefixes from the token's places on."""
    n, room, need = ([F.col(f"{s}.{c}") for s in (x, y)] for c in ("n", "room", "need"))
    return (den * F.least(*n) >= num * F.greatest(*n)) & (F.least(*room) >= F.greatest(*need))


def _near(x: str, y: str, num: int, den: int) -> Column:
    """Whether the parities leave room for a similarity of num/den: sets differ in no fewer tokens than parities."""
    total = F.col(f"{x}.n") + F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in PARITY), F.lit(0))
    return den * (total - differ) >= num * (total + differ)


def _ordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _entries(groups: DataFrame, crowded: DataFrame) -> DataFrame:
    """(token, g, n, need, room): the rarest shared tokens of every group that has enough of them; room is the number of
    shared tokens of its prefix from this one on."""
    heads = groups.join(small(crowded), "g", "left").filter("rep is null or rep = digest")
    tokens = heads.select("g", "n", "need", F.explode("prefix").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1")
    of_group = Window.partitionBy("g")
    ranked = tokens.join(counts, "token").withColumn("place", F.row_number().over(of_group.orderBy("sets", "token"))).withColumn(
        "shared", F.count("*").over(of_group))
    # tokens of no other prefix would come first in the order; they find nothing
    return staged(ranked.withColumn("room", F.col("shared") - F.col("place") + 1).filter("room >= need").select(
        "token", "g", "n", "need", "room"), "join-entries")


def links(sets: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Components (node, root) of set digests under similarity num/den; sets without a possible partner are left out."""
    groups = staged(sets.filter("n > 0").drop("doc_id", "h").dropDuplicates(["digest"]), "join-groups", compression="zstd")
    crowded = staged(groups.groupBy("g").agg(F.min("digest").alias("rep"), F.count("*").alias("size")).filter("size > 1").select("g", "rep"), "join-crowded")
    entries = _entries(groups, crowded)
    needed = small(staged(entries.select("g").union(crowded.select("g")).distinct(), "join-needed"))
    members = staged(groups.drop("prefix").join(needed, "g", "leftsemi"), "join-members", compression="zstd")
    first = members.groupBy("g").agg(F.min(F.struct("digest", "n", *PARITY)).alias("rep"), F.count("*").alias("members"))

    # the hub of a token shares most of its prefix with others; the same set is then the hub of most of its tokens
    degree = entries.groupBy("g").agg((-F.count("*")).alias("degree"))
    hubs = staged(entries.join(degree, "g").groupBy("token").agg(F.min(F.struct("degree", "g", "n", "need", "room")).alias("hub"), F.count("*").alias("size")).filter(
        "size > 1").select("token", "hub.g", "hub.n", "hub.need", "hub.room").join(
            first.select("g", F.col("rep.digest").alias("rep"), *(f"rep.{w}" for w in PARITY)), "g"), "join-hubs")
    star = entries.alias("e").join(hubs.alias("h"), "token").filter((F.col("e.g") != F.col("h.g")) & _fits("e", "h", num, den)).select("e.g", "h.rep", "h.n", *(f"h.{w}" for w in PARITY)).distinct()
    own = first.filter("members > 1").select("g", F.col("rep.digest").alias("rep"), "rep.n", *(f"rep.{w}" for w in PARITY))
    tried = star.union(own).alias("h").join(members.alias("e"), "g").filter((F.col("e.digest") != F.col("h.rep")) & _near("e", "h", num, den)).select(
        *_ordered("h.rep", "e.digest"))
    pairs = staged(_possible(tried, members, num, den), "join-star-pairs")
    items = _items(pairs.select(F.col("a").alias("digest")).union(pairs.select("b")), docs, k, "join-star")
    known = components(_verify(pairs, items, num, den, "join-star"), "join-star")

    rooted = staged(members.select("digest", "g", "n", "need", *PARITY).join(known, F.col("digest") == F.col("node"), "left").select(
        "digest", "g", "n", "need", *PARITY, F.coalesce("root", "digest").alias("root")), "join-rooted")
    # a group is one more list of sets, named by a hash of its name, in which places say nothing
    lists = entries.select("token", "g", "room").join(hubs.select("token", "rep"), "token").union(
        crowded.select(F.xxhash64("g"), "g", F.lit(None).cast("long"), "rep"))
    rest = staged(lists.join(rooted, "g").filter("digest <> rep").select(
        "token", "digest", "n", "need", F.coalesce("room", "n").alias("room"), "root", *PARITY), "join-lists")
    rooted, items, width, turn = rooted.select("digest", "root"), None, HUBS, 0
    while True:
        name = f"join-late-{turn}"
        mixed = rest.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token")
        rest = staged(rest.join(mixed, "token", "leftsemi"), f"{name}-rest")
        if rest.isEmpty():
            return rooted.select(F.col("digest").alias("node"), "root")
        sizes = rest.groupBy("token", "root").agg(F.count("*").alias("size"))
        smallest = Window.partitionBy("token").orderBy("size", "root", "digest")
        hubs = staged(rest.join(sizes, ["token", "root"]).withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= width).drop("size", "place"), f"{name}-hubs")
        tried = rest.alias("e").join(hubs.alias("h"), "token").filter((F.col("e.root") != F.col("h.root")) & _fits("e", "h", num, den) & _near("e", "h", num, den)).select(
            *_ordered("e.digest", "h.digest"))
        pairs = staged(_possible(tried, members, num, den), f"{name}-pairs")
        rest = rest.join(hubs.select("token", "digest"), ["token", "digest"], "leftanti")
        if not pairs.isEmpty():
            if items is None:
                items = _items(rest.select("digest").union(hubs.select("digest")), docs, k, "join-late")
            found = _verify(pairs, items, num, den, name)
            of = rooted.select(F.col("digest").alias("a"), F.col("root").alias("x")), rooted.select(F.col("digest").alias("b"), F.col("root").alias("y"))
            moves = small(staged(components(found.join(of[0], "a").join(of[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b")), name).select(
                F.col("node").alias("root"), F.col("root").alias("to")), f"{name}-moves"))
            rest, rooted = (t.join(moves, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to") for t in (rest, rooted))
            rooted = staged(rooted.select("digest", "root"), f"{name}-rooted")
        width, turn = 8 * width, turn + 1


def link(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, h, n_shingles, component_id) for every row; h is the hash of its text.

    Texts without words have no set and are linked with nothing. Rows with equal sets are linked. component_id is the
    smallest identifier reachable by links; null identifiers are passed over, and it is null where there is no other.
    """
    rows = _sets(docs, k, num, den)
    found = links(rows, docs, k, num, den)
    least = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"))
    rooted = least.join(found, F.col("digest") == F.col("node"), "left").select("digest", "least", F.coalesce("root", "digest").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_set = rooted.join(lowest, "root").select("digest", "component")
    full = rows.filter("n > 0").join(of_set, "digest").select("doc_id", "h", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return full.union(rows.filter("n = 0").select("doc_id", "h", "n", "doc_id"))


def op2_jaccard(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per document: size of its set of k-word shingles and the smallest identifier of its component.

    Null, empty and blank texts have empty sets and stay alone; a text with fewer than k words is one shingle. Repeated
    rows are returned as often as they occur.
    """
    return link(docs, k, num, den).drop("h")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns, with one document of each component: the one with the smallest identifier.

    Among rows that share that identifier the smallest text hash stays, and of equal rows one. A component without any
    identifier has no such document and keeps its different texts, each once. Texts without words are all kept.
    """
    rows = staged(link(docs, k, num, den), "join-linked").filter("n_shingles > 0")
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    ranked = rows.filter("component_id is not null").groupBy("component_id").agg(F.min(key).alias("kept"))
    out = rows.join(ranked, "component_id").filter(~(key.eqNullSafe(F.col("kept")))).select("doc_id", "h").distinct()
    again = rows.groupBy("doc_id", "h").count().filter("count > 1").select("doc_id", "h")
    own = docs.columns
    hashed = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))

    def match(other: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        other = small(staged(other.select(F.col("doc_id").alias("__id"), F.col("h").alias("__k")), "join-out"))
        return rows.join(other, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__k")), how)

    kept = match(out, "leftanti", hashed)
    single, several = match(again, "leftanti", kept), match(again, "leftsemi", kept)
    return single.union(several.dropDuplicates(["doc_id", "__h"])).select(*own)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN generate_series(1, len(w) - 2)] END) AS t FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, ways.y FROM reach r JOIN ways ON ways.x = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON a = d.doc_id"""
