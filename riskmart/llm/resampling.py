"""Target-distribution importance resampling: hashed word runs, array-scored weights, distributed quickselect.

Every run of words is a feature and falls into one of a fixed number of buckets. Buckets are counted over the whole
corpus and over the whole target (map-side combined), so the log ratios of both distributions fit one array, a constant
of the plan. A document's weight is the mean gain of its features, looked up in that array; with Gumbel noise from a
hash of its identifier the k highest scores are a draw without replacement.

The k-th composite key (score, identifier, stored row) is found by quickselect: each round draws random pivot keys from
the range that remains, counts exactly what lies before, at and behind each of them, and keeps the interval that holds
the k-th. The driver sees pivots and counts only. Winners alone are then sorted by range and ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import staged
from riskmart.llm.decontamination import words
from riskmart.llm.sharding import numbered

BUCKETS = 10_000
SEED = 2024
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
#: Drawn share of the eligible documents, as a fraction.
SHARE = (10, 100)
#: Random pivot keys of one round of the selection.
PIVOTS = 31

ADDED = ["n_features", "weight", "score", "rank"]


def runs(found: Column, longest: int) -> Column:
    """All runs of 1 to `longest` consecutive words of an array, each joined by one space, repeats kept."""
    parts = [found]
    for n in range(2, longest + 1):
        # the runs one word shorter, each with the word behind it: linear in the length of the text
        more = F.greatest(F.size(found) - (n - 1), F.lit(0))
        parts.append(F.zip_with(F.slice(parts[-1], 1, more), F.slice(found, n, more), lambda run, word: F.concat_ws(" ", run, word)))
    return F.concat(*parts) if longest > 1 else found


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> dict[int, int]:
    """Occurrences of features by bucket over all texts; at most `buckets` rows reach the driver."""
    each = texts.select(words(F.col("text")).alias("w")).select(F.explode(runs(F.col("w"), longest)).alias("f"))
    return {r[0]: r[1] for r in each.groupBy(bucket(F.col("f"), buckets).alias("b")).count().collect()}


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio of target to source share, one added to every bucket, rounded down."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return [math.floor(1000 * math.log(((target.get(b, 0) + 1) * (s_all + buckets)) / ((source.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets)]


def scored(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns of every row with n_words, n_features, weight and score."""
    if taken := {"n_words", *ADDED} & set(carry):
        raise ValueError(f"columns that the operator adds: {sorted(taken)}")
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets), buckets)
    # one folded literal, bounded by the number of buckets
    known = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    own = [F.col(c).alias(f"__{i}") for i, c in enumerate(carry)]
    rows = docs.select(*own, F.col("doc_id").cast("string").alias("__id"), words(F.col("text")).alias("__w"))
    rows = rows.withColumn("__f", runs(F.col("__w"), longest))
    total = F.aggregate("__f", F.lit(0).cast("bigint"), lambda a, f: a + F.get(known, bucket(f, buckets)))
    rows = rows.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(carry)), "__id", F.size("__w").cast("bigint").alias("n_words"),
                       F.size("__f").cast("bigint").alias("n_features"), total.alias("__total"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("__id", F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    mean = F.when(F.col("n_features") > 0, F.expr("(__total - pmod(__total, n_features)) div n_features")).otherwise(F.lit(0)).cast("bigint")
    return rows.withColumn("weight", mean).withColumn("score", (F.col("weight") + noise).cast("bigint")).drop("__id", "__total")


def kth_key(rows: DataFrame, key: list[str], k: int, pivots: int = PIVOTS) -> tuple:
    """Values of the k-th smallest (from 1) composite key of rows, nulls first; a round reads what is left twice.

    Pivots are random keys (lowest hashes under the number of the round), so a round leaves about 2 / pivots of the rows
    whatever their order; equal keys are counted together and end the search when the k-th is among them.
    """
    n = rows.count()
    if not 1 <= k <= n:
        raise ValueError(f"no row {k} of {n}")
    kinds = [rows.schema[c].dataType for c in key]
    own = F.struct(*key)

    def literal(values: tuple) -> Column:
        return F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(values, kinds, key)))

    rest, before, turn = rows.select(*key), 0, 0
    low = high = None
    while True:
        left = rest
        if low is not None:
            left = left.filter(own > literal(low))
        if high is not None:
            left = left.filter(own < literal(high))
        drawn = left.orderBy(F.xxhash64(*key, F.lit(turn)), *key).limit(pivots)
        at = [tuple(r) for r in drawn.distinct().orderBy(*key).collect()]
        points = F.array(*map(literal, at))
        place = left.select(F.size(F.filter(points, lambda p: p < own)).alias("passed"), F.exists(points, lambda p: p == own).alias("same"))
        counts = {(r["passed"], r["same"]): r["n"] for r in place.groupBy("passed", "same").agg(F.count("*").alias("n")).collect()}
        for i in range(len(at) + 1):
            between = counts.get((i, False), 0)
            if before + between >= k:
                low, high = at[i - 1] if i else low, at[i] if i < len(at) else high
                break
            before += between
            same = counts.get((i, True), 0)
            if before + same >= k:
                return at[i]
            before += same
        turn += 1


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, share: tuple[int, int] = SHARE,
             least_words: int = LEAST_WORDS, carry: tuple[str, ...] = ("doc_id",), pivots: int = PIVOTS) -> DataFrame:
    """The carried columns of every row with n_features, weight, score and rank; rank is null for rows not drawn.

    floor(share * N) of the N rows with enough words are drawn, highest score first, ties to the smaller doc_id (null
    first). Rows that tie in both, such as repeated rows, are told apart by their stored place: exactly as many as asked
    for are drawn. A null text has no words, a null doc_id hashes as the empty text; an empty target or corpus counts
    nothing. Columns of docs that are not carried play no part; carried ones must not have an added column's name.
    """
    carry = tuple(dict.fromkeys(("doc_id", *carry)))
    rows = staged(scored(docs, target, longest, buckets, seed, carry).withColumn("__row", F.monotonically_increasing_id()).withColumn(
        "__high", -F.col("score")), "resample-scored")
    eligible = F.col("n_words") >= least_words
    k = share[0] * rows.filter(eligible).count() // share[1]
    out = [*carry, "n_features", "weight", "score", "rank"]
    if not k:
        return rows.withColumn("rank", F.lit(None).cast("bigint")).select(*out)
    key = ["__high", "doc_id", "__row"]
    last = kth_key(rows.filter(eligible), key, k, pivots)
    kinds = [rows.schema[c].dataType for c in key]
    won = eligible & (F.struct(*key) <= F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(last, kinds, key))))
    winners = numbered(rows.filter(won), key, "__no").withColumn("rank", F.col("__no") + 1)
    return winners.select(*out).unionByName(rows.filter(~won).withColumn("rank", F.lit(None).cast("bigint")).select(*out))


def op12_resampling(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: n_features, weight, score, and its rank among the drawn tenth, else null.

    Null, empty and wordless texts have weight 0 and are never drawn; an empty table gives no rows.
    """
    return resample(docs, target).select("doc_id", *ADDED)


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

SQL = f"""
WITH t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT rid, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
known AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
bytes AS (SELECT word, [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(word)), '..')] AS bs FROM known),
bucketed AS (SELECT word, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bs), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % {BUCKETS} AS b FROM bytes, t),
s AS (SELECT b, count(*) AS s FROM dw JOIN bucketed USING (word) GROUP BY b),
g AS (SELECT b, count(*) AS t FROM bw JOIN bucketed USING (word) GROUP BY b),
totals AS (SELECT (SELECT count(*) FROM dw) AS ss, (SELECT count(*) FROM bw) AS tt),
gains AS (SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * (ss + {BUCKETS})) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (tt + {BUCKETS})))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT b FROM bucketed) LEFT JOIN s USING (b) LEFT JOIN g USING (b), totals),
sums AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM dw JOIN bucketed USING (word) JOIN gains USING (b) GROUP BY rid),
scored AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_features,
  CASE WHEN n IS NULL THEN 0 ELSE CAST((total - ((total % n) + n) % n) // n AS BIGINT) END AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM d LEFT JOIN sums USING (rid)),
ranked AS (SELECT rid, row_number() OVER (ORDER BY weight + noise DESC, doc_id, rid) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score,
  CASE WHEN rank <= {SHARE[0]} * n // {SHARE[1]} THEN CAST(rank AS BIGINT) END AS rank
FROM scored LEFT JOIN ranked USING (rid)"""
