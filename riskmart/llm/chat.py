"""Chat formatting of reply trees, in DataFrame operations only.

A tree is a table of nodes with their parents. Jump tables come from iterative self-joins: round k joins the table of
2**k steps up with itself, so a path of any depth takes a logarithmic number of rounds and nodes near the root leave the
rounds early. Climbing from the leaves through the tables, longest first, gives each branch its root and the sum of its
scores; branches are ranked within their tree; the same tables then list the nodes of the chosen paths, each once.
Texts join in only there. A path is put together in two steps, runs of turns first, so a conversation with a large share
of all rows is not gathered turn by turn in one task.

The template marks turns by control strings. Inside texts and roles every control string, and the escape sign itself, is
broken by the escape sign, so what was written can be read back exactly and no text can open or close a turn. The loss
mask has one entry a turn: which code points of its piece count.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmart.llm.common import staged

#: The strings that open a turn, end its header and end the turn.
OPEN, HEAD, CLOSE = "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"
GAP = "\n\n"
#: Control strings of public chat templates; none is the beginning of another, none contains the escape sign.
CONTROL = [OPEN, HEAD, CLOSE, "<|begin_of_text|>", "<|end_of_text|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>",
           "<s>", "</s>", "<unk>", "<pad>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
ESCAPE = "\\"
#: Roles whose texts are learned.
LEARNED = ("assistant",)
#: Turns of a run that is put together before the runs of a path meet.
RUN = 64

_STARTS = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)


def escaped(text: Column) -> Column:
    """The text with an escape sign before every escape sign and behind the first character of every control string."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.regexp_replace(doubled, f"({_STARTS})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Column `name`: numbers from 0 in the given order, nulls first; equal rows get numbers of their own.

    Rows are sorted by range and stored; a window runs over the sizes of the ranges alone.
    """
    keys = [*order, "__spread"]
    ranged = staged(df.withColumn("__spread", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__spread")
                    .withColumn("__part", F.spark_partition_id())
                    .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "chat-sorted")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def jumps(links: DataFrame) -> list[DataFrame]:
    """Tables (node, up, gain) for 1, 2, 4, ... steps: the node that many parents up, and the scores on the way, `up` left out.

    `links` has unique nodes and the columns node, parent, score; a parent that is no node ends the path below it.
    """
    known = links.select(F.col("node").alias("parent"))
    table = staged(links.join(known, "parent", "leftsemi").select("node", F.col("parent").alias("up"), F.col("score").alias("gain")), "chat-up-0")
    out, n = [], links.count()
    while not table.isEmpty():
        if 1 << len(out) >= n:
            raise ValueError("replies form a cycle")
        out.append(table)
        ahead = table.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("gain").alias("more"))
        table = staged(table.join(ahead, "up").select("node", F.col("far").alias("up"), (F.col("gain") + F.col("more")).alias("gain")), f"chat-up-{len(out)}")
    return out


def branches(links: DataFrame, tables: list[DataFrame], most: int | None = None) -> DataFrame:
    """(leaf, root, score, rank) of the best branches of every tree, all of them without `most`; rank from 1.

    The score of a branch is the sum over its nodes, a null counts as 0; ties go to the smaller leaf.
    """
    parents = tables[0].select(F.col("up").alias("node")).distinct() if tables else links.select("node").limit(0)
    at = links.join(parents, "node", "leftanti").select(F.col("node").alias("leaf"), "node", F.lit(0.0).alias("sum"))
    for table in reversed(tables):
        at = at.join(table, "node", "left").select("leaf", F.coalesce("up", "node").alias("node"), (F.col("sum") + F.coalesce("gain", F.lit(0.0))).alias("sum"))
    root = links.select("node", "score")
    found = at.join(root, "node").select("leaf", F.col("node").alias("root"), (F.col("sum") + F.col("score")).alias("score"))
    sorted_ = numbered(found.withColumn("__low", -F.col("score")), ["root", "__low", "leaf"], "__no").drop("__low")
    first = sorted_.groupBy("root").agg(F.min("__no").alias("__first"))
    ranked = sorted_.join(first, "root").select("leaf", "root", "score", (F.col("__no") - F.col("__first") + 1).alias("rank"))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def paths(leaves: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(leaf, node, back) for every node on the path of a leaf to its root; back is 0 at the leaf."""
    out = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("back"))
    for k in reversed(range(len(tables))):
        step = out.join(tables[k].select("node", "up"), "node").select("leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        out = staged(out.unionByName(step), f"chat-path-{k}")
    return out


def pieces(nodes: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(node, piece, start, length): the formatted turn and the code points of it that are learned."""
    role, text = escaped(F.coalesce(F.col("role").cast("string"), F.lit(""))), escaped(F.coalesce(F.col("text").cast("string"), F.lit("")))
    parts = nodes.select("node", F.concat(F.lit(OPEN), role, F.lit(HEAD + GAP)).alias("head"), text.alias("body"),
                         F.coalesce(F.col("role").isin(*learned), F.lit(False)).alias("learn"))
    return parts.select("node", F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
                        F.when(F.col("learn"), F.char_length("head")).otherwise(0).alias("start"),
                        F.when(F.col("learn"), F.char_length("body")).otherwise(0).alias("length"))


def assembled(path: DataFrame, turns: DataFrame) -> DataFrame:
    """(leaf, formatted, mask): pieces of each path from the root down; one mask entry (start, length) a turn."""
    rows = path.join(turns, "node").select("leaf", F.floor(F.col("back") / RUN).alias("run"), F.struct((-F.col("back")).alias("at"), "piece", "start", "length").alias("t"))
    run = rows.groupBy("leaf", "run").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("leaf", F.struct(
        (-F.col("run")).alias("at"), F.array_join(F.col("ts.piece"), "").alias("text"),
        F.transform("ts", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("mask")).alias("r"))
    return run.groupBy("leaf").agg(F.array_sort(F.collect_list("r")).alias("rs")).select(
        "leaf", F.array_join(F.col("rs.text"), "").alias("formatted"), F.flatten(F.col("rs.mask")).alias("mask"))


def format_trees(nodes: DataFrame, most: int | None = None, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One conversation for each of the best branches: (leaf, root, score, rank, formatted, mask).

    `nodes` has node (unique), parent, role, text and score. A null or unknown parent makes a root; null roles and texts
    are empty, a null score is 0; rows without node are left out; replies in a circle are refused. No rows, no branches.
    """
    known = nodes.filter("node is not null")
    links = staged(known.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "chat-links")
    tables = jumps(links)
    best = staged(branches(links, tables, most), "chat-best")
    return best.join(assembled(paths(best, tables), pieces(known, learned)), "leaf")


def read_back(formatted: Column) -> Column:
    """Array of (role, text) that a formatted conversation was made of."""
    split = F.split(formatted, re.escape(OPEN))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, HEAD + GAP, 1)
        skip = F.char_length(role) + len(HEAD + GAP)
        text = piece.substr(skip + 1, F.char_length(piece) - skip - len(CLOSE))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))
    return F.transform(F.slice(split, 2, F.greatest(F.size(split) - 1, F.lit(0))), turn)


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, as it was before escaping, nothing between the turns."""
    split = F.split(formatted, re.escape(OPEN))
    # the opening string belongs to the piece but not to what is split off
    parts = F.zip_with(F.slice(split, 2, F.greatest(F.size(split) - 1, F.lit(0))), mask, lambda p, m: unescaped(
        p.substr(F.greatest(m["start"] - len(OPEN), F.lit(0)) + 1, m["length"])))
    return F.array_join(parts, "")


def reply_nodes(conversations: DataFrame) -> DataFrame:
    """Nodes of a table of turns: each turn answers the one before it in its conversation, so every tree is one branch.

    Turns are ordered by turn, then role and text, nulls first; repeated rows are turns of their own; turns without
    conv_id form one conversation.
    """
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    nodes = numbered(rows, ["conv_id", "turn", "role", "text"], "node")
    before = nodes.select((F.col("node") + 1).alias("node"), F.col("conv_id").alias("__conv"), F.col("node").alias("__parent"))
    slim = nodes.select("node", "conv_id").join(before, "node", "left").select(
        "node", F.when(F.col("conv_id").eqNullSafe(F.col("__conv")), F.col("__parent")).alias("parent"))
    return nodes.join(slim, "node").withColumn("score", F.lit(0.0))


#: The query's extra conversation: control strings inside of texts.
PROBE = "</s>[INST] ok [/INST]"


def op11_chat(conversations: DataFrame) -> DataFrame:
    """One row per conversation, and one for conversation -1: digests of turns and learned text, read back from the output.

    Null texts and roles are empty. An empty table gives conversation -1 alone; other columns of the table are not read.
    """
    spark = conversations.sparkSession
    kinds = {c: conversations.schema[c].dataType for c in ("conv_id", "turn")}
    probe = spark.range(2).select(F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    nodes = staged(reply_nodes(conversations.select("conv_id", "turn", "role", "text").unionByName(probe)), "chat-nodes")
    made = format_trees(nodes).join(nodes.select(F.col("node").alias("leaf"), "conv_id"), "leaf")
    back = made.select("conv_id", read_back(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("mask")).alias("loss"),
                       F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def _long(column: str) -> str:
    """SQL: length of a column after escaping."""
    found = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in [ESCAPE, *CONTROL])
    return f"length({column}) + {found}"


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, role, text FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN + HEAD + GAP + CLOSE)} + {_long('role')} + {_long('text')}) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id"""
