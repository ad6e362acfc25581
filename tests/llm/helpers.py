"""Small corpora for the tests: edge cases, and random texts with exact and near copies."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Extra columns whose names the operators use inside or return.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, shard int, key string, h long, n long, r int, "
          "row string, component_id long, word string, label int")


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Documents of (doc_id, text) with the usual and some clashing columns."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, 1, "k", 2, 3, 4, "r", -1, "w", 7) for i, t in rows], SCHEMA)


LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(60_000))
EDGES = [(None, None), (None, "no identifier here at all"), (1, None), (2, ""), (3, " \t\n  "), (4, "word"), (5, "two words"), (6, "word"),
         (6, "word"), (7, LONG), (8, LONG), (9, "Ünïcödé ÉÈ 漢字 😀   mixed\x00nul"), (4, "another text under a used identifier"), (-3, "negative")]


def corpus(n: int, seed: int, vocabulary: int = 300, copies: float = 0.4, length: tuple[int, int] = (5, 160)) -> list[tuple[int, str]]:
    """Random texts; part of them are exact or near copies of earlier ones, or share a passage."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rnd.randint(1, 4))) for _ in range(vocabulary)]
    passage = [rnd.choice(words) for _ in range(70)]
    out: list[tuple[int, str]] = []
    for i in range(n):
        if out and rnd.random() < copies:
            w = rnd.choice(out)[1].split(" ")
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
        else:
            w = [rnd.choice(words) for _ in range(rnd.randint(*length))]
        if rnd.random() < 0.15:
            at = rnd.randrange(len(w) + 1)
            w[at:at] = passage[rnd.randint(0, 10):rnd.randint(55, 70)]
        out.append((i, " ".join(w)))
    return out
