import random
from itertools import combinations

import numpy as np

from riskmart.llm import toxicity as X
from tests.llm.helpers import EDGES, LONG, table

INSULTS = ["idiot", "moron", "stupid", "pathetic"]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def slow_kernel(a, b):
    def profile(w):
        out = {}
        for c in combinations(range(len(w)), X.ORDER):
            if c[-1] - c[0] + 1 <= X.SPAN:
                u = tuple(w[i] for i in c)
                out[u] = out.get(u, 0) + X.DECAY ** (c[-1] - c[0] + 1)
        return out
    p, q = profile(a), profile(b)
    dot = lambda x, y: sum(v * y.get(u, 0) for u, v in x.items())
    return dot(p, q) / max((dot(p, p) * dot(q, q)) ** 0.5, 1e-300)


def test_kernel_against_its_definition():
    rnd = random.Random(1)
    marks = ["idiot", "stupid", "aaaa", "ñandú", "abcabcabc"]
    batch = [*marks, "id-iot", "i.d.i.o.t", "ab", "", "stuupid", "xyz", *("".join(rnd.choice("abcidot") for _ in range(rnd.randint(1, 14))) for _ in range(60))]
    got = X.Kernel(marks)(batch)
    for i, w in enumerate(batch):
        for j, m in enumerate(marks):
            want = slow_kernel(w, m)
            assert abs(got[i, j] - (want if want >= X.FLOOR else 0)) < 1e-4 or abs(want - X.FLOOR) < 1e-4
    assert got[batch.index("id-iot"), 0] > X.FLOOR and np.allclose(np.diag(got[:5]), 1, atol=1e-5)


def test_words():
    assert X.words("He said: 'STUPID!' i d i o t, a.b") >= {"he", "said", "stupid", "idiot", "a.b"}
    assert X.words(None) == X.words("") == X.words(" ... ") == set()


def make(n, seed):
    rnd = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ti", "es", "or"]
    docs, marks = [], {}
    for i in range(n):
        w = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(20, 80))]
        if i % 5 == 0:
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(INSULTS)
        docs.append((i, " ".join(w)))
        marks[i] = int(i % 5 == 0)
    return docs, marks


def test_learns_and_tolerates_inserted_letters(spark):
    docs, marks = make(500, 3)
    known = labels(spark, [(i, 1, t, "x") for i, t in marks.items()])
    odd = [(1000 + k, "then the ande heres " + w) for k, w in enumerate(["id-iot", "mo.ron", "stu*pid", "pa-thetic", "s t u p i d", "IDIOT!!"])]
    rows = {r["doc_id"]: r for r in X.op4_toxicity(table(spark, [*docs, *odd]), known).collect()}
    held = [i for i in marks if rows[i]["held_out"]]
    assert len(held) > 60 and sum(rows[i]["predicted"] == marks[i] for i in held) >= len(held) - 1
    assert sum(rows[i]["predicted"] for i, _ in odd) >= 5
    flipped = labels(spark, [(i, 1, 1 - t if rows[i]["held_out"] else t, "x") for i, t in marks.items()])
    again = {r["doc_id"]: r["score"] for r in X.op4_toxicity(table(spark, docs), flipped).collect()}
    # held-out labels are not learned from
    assert all(abs(again[i] - rows[i]["score"]) < 1e-9 for i in marks)


def test_filter_keeps_columns(spark):
    docs, marks = make(200, 4)
    before = table(spark, [*docs, *EDGES])
    after = X.without_toxic(before, labels(spark, [(i, 1, t, "x") for i, t in marks.items()]))
    assert after.columns == before.columns and after.schema["n_chars"].dataType == before.schema["n_chars"].dataType
    left = [r["text"] for r in after.collect()]
    assert LONG in left and None in left and not any(t and any(w in t.split() for w in INSULTS) for t in left)
    assert len(left) >= len(docs) * 0.8 + len(EDGES) - 2


def test_edges(spark):
    some = labels(spark, [(1, 0, 1, ""), (1, 0, 0, ""), (4, 0, 1, ""), (5, 0, None, ""), (6, 0, 0, ""), (None, 0, 1, ""), (9, 0, 0, "")])
    for known in (some, labels(spark, []), labels(spark, [(4, 1, 1, "")])):
        rows = X.op4_toxicity(table(spark, EDGES), known).collect()
        assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows}) == 1
    assert X.op4_toxicity(table(spark, []), some).count() == 0
