"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

Test items become windows of consecutive words. The corpus is counted for the words of the benchmark; windows with a word
that never occurs are done. Of every other window the rarest words lead: their postings (text, position) are stored
as the index, shifted by the word's place in the window, and intersected from the rarest list on, so only texts that
hold the leading words in the right distance remain. Those few are compared word by word. For proximity, `near` keeps
the shifted lists apart by up to a slack instead of equal.

Texts are known by their MD5, so copies share one entry and null or repeated identifiers do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmart.llm.common import small, staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: How many of its rarest words lead a window.
LEADING = 2


def words(text: Column) -> Column:
    """Words of a whole text, A-Z lowered; a null text has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, window, terms): distinct runs of `size` words of each item; an item with fewer words, but any, is one run."""
    terms = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("all")).filter(F.size("all") > 0)
    runs = terms.select("item", "all", F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))).alias("s")).select(
        "item", F.slice("all", F.col("s"), size).alias("terms"))
    return runs.distinct().withColumn("window", F.unhex(F.md5(F.concat_ws(" ", "terms").cast("binary"))))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, key, pos) for every occurrence of the given terms in the texts of docs; positions from 0."""
    # the key is formed below the generator, once for each text and not for each word
    keyed = docs.select(text_key(F.col("text")).alias("key"), words(F.col("text")).alias("all"))
    spread = keyed.select("key", F.posexplode("all").alias("pos", "term"))
    return spread.join(small(terms.select("term").distinct()), "term")


def _leading(runs: DataFrame, docs: DataFrame, leading: int) -> DataFrame:
    """(window, rank, offset, term, size): the rarest distinct places of each window that can occur, rarest first."""
    places = runs.select("window", "terms").distinct().select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    vocabulary = staged(places.select("term").distinct(), "leak-terms")
    counts = staged(docs.select(F.explode(words(F.col("text"))).alias("term")).join(small(vocabulary), "term").groupBy("term").agg(
        F.count("*").alias("n")), "leak-counts")
    known = places.join(counts, "term").withColumn("found", F.count("*").over(Window.partitionBy("window"))).filter("found = size")
    order = Window.partitionBy("window").orderBy("n", "term", "offset")
    return known.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= leading).select("window", "rank", "offset", "term", "size")


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW, leading: int = LEADING) -> DataFrame:
    """(key, hits): for texts with any window of an item, the distinct array of (start, size, items of the window)."""
    runs = staged(windows(items, size), "leak-windows")
    lead = staged(_leading(runs, docs, leading), "leak-lead")
    index = staged(postings(docs, lead), "leak-index")
    found = index.join(small(lead.filter("rank = 1")), "term").select(
        "window", "size", "key", (F.col("pos") - F.col("offset")).alias("start")).filter("start >= 0").distinct()
    for rank in range(2, leading + 1):
        # the place where the next list must have the text; windows without a word of this rank pass on
        due = found.join(small(lead.filter(F.col("rank") == rank).drop("size")), "window").select(
            "window", "size", "key", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
        found = due.join(index, ["key", "term", "pos"], "leftsemi").select("window", "size", "key", "start").unionByName(
            found.filter(F.col("size") < rank))
    sets = runs.groupBy("window").agg(F.first("terms").alias("terms"), F.sort_array(F.collect_set("item")).alias("items"))
    near = staged(found, "leak-candidates").join(sets, "window").select("key", F.struct("start", "terms", "items").alias("c"))
    asked = staged(near.groupBy("key").agg(F.collect_set("c").alias("cs")), "leak-asked")
    keys = small(asked.select("key"))
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").join(keys, "key", "leftsemi").dropDuplicates(["key"])
    checked = texts.select("key", words(F.col("text")).alias("all")).join(asked, "key").select("key", F.filter(
        "cs", lambda c: F.slice("all", c["start"] + 1, F.size(c["terms"])) == c["terms"]).alias("cs"))
    return checked.filter(F.size("cs") > 0).select("key", F.transform("cs", lambda c: F.struct(
        c["start"].alias("start"), F.size(c["terms"]).alias("size"), c["items"].alias("items"))).alias("hits"))


def near(docs: DataFrame, phrases: DataFrame, slack: int = 0) -> DataFrame:
    """Phrase and proximity search: (phrase, key, start) where the terms of a phrase follow in order, each at most `slack`
    words later than its place in the phrase. `phrases` has columns phrase and terms (array of lower-case words).

    Lists are intersected from the rarest term on; with slack 0 the matches are exact phrases.
    """
    places = phrases.filter(F.size("terms") > 0).select("phrase", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    index = staged(postings(docs, places), "leak-near").distinct()
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    ranked = staged(places.join(counts, "term").withColumn("found", F.count("*").over(Window.partitionBy("phrase"))).filter("found = size").withColumn(
        "rank", F.row_number().over(Window.partitionBy("phrase").orderBy("n", "term", "offset"))), "leak-ranked")
    longest = ranked.agg(F.max("size")).first()[0] or 0
    kept = index.join(ranked, "term").select("phrase", "size", "rank", "offset", "key", (F.col("pos") - F.col("offset")).alias("at"))
    out = kept.filter("rank = 1").select("phrase", "size", "key", F.col("at").alias("start"), F.explode(
        F.sequence(F.col("at") - slack, F.col("at"))).alias("base")).filter("base >= 0").select("phrase", "size", "key", "base").distinct()
    for rank in range(2, longest + 1):
        step = kept.filter(F.col("rank") == rank).select("phrase", "key", F.explode(F.sequence(F.col("at") - slack, F.col("at"))).alias("base")).distinct()
        out = out.join(step, ["phrase", "key", "base"], "leftsemi").unionByName(out.filter(F.col("size") < rank))
    return out.select("phrase", "key", F.col("base").alias("start"))


def _per_text(hits: DataFrame) -> DataFrame:
    """(key, n_hit, n_items, items): distinct word places inside occurrences, and the items they belong to."""
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    items = F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return hits.select("key", F.size(places).cast("long").alias("n_hit"), items.alias("items"))


def op1_decontamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: words, words inside an occurrence of a test window, and the items concerned.

    Null, empty and wordless texts have no words and no hits; null, empty and wordless items have no windows, an item
    without identifier counts as the empty identifier, and repeated items count once. Repeated documents are reported
    one by one. Without items nothing is contaminated.
    """
    hits = _per_text(occurrences(docs, items, size))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(small(staged(hits, "leak-hits")), "key", "left")
    listed = F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>")))
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                         F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                         F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, without documents that hold a window of an item."""
    bad = small(staged(occurrences(docs, items, size).select(F.col("key").alias("__leak")), "leak-bad"))
    return docs.join(bad, text_key(F.col("text")) == F.col("__leak"), "leftanti")


WORDS_SQL = r"[x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS_SQL} AS w FROM benchmark),
r AS (SELECT item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, array_to_string(w[s : s + {WINDOW - 1}], ' ') AS terms, len(w[s : s + {WINDOW - 1}]) AS size FROM r),
sizes AS (SELECT DISTINCT size FROM win),
word AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS s FROM d),
run AS (SELECT rid, s, list(word) OVER (PARTITION BY rid ORDER BY s ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS g FROM word),
sized AS (SELECT rid, s, size, array_to_string(g[1 : size], ' ') AS terms FROM run CROSS JOIN sizes WHERE len(g) >= size),
hit AS (SELECT rid, s, size, item FROM sized JOIN win USING (size, terms)),
places AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + size - 1)) AS place FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)"""
