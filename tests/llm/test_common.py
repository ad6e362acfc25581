import random

import numpy as np

from riskmart.llm import common
from riskmart.llm.common import components, shingles, word_hashes


def test_word_hashes_follow_words():
    texts = ["a b  a\tB", "É é x\x0by\x0c\rz", "", None, "  lead and trail  ", "nul\x00inside nul\x00inside"]
    for t in texts:
        words = (t or "").encode().lower().split()
        hashes = word_hashes(t).tolist()
        assert len(hashes) == len(words)
        assert all((a == b) == (x == y) for a, x in zip(words, hashes) for b, y in zip(words, hashes))


def test_shingles():
    w = word_hashes("a b c d a b c")
    assert len(shingles(w, 3)) == 5 and shingles(w, 3)[0] == shingles(w, 3)[4]
    assert len(shingles(w[:2], 3)) == 1 and len(shingles(w[:0], 3)) == 0


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 90)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long"), "t").collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0
    assert np.all([k >= v for k, v in got.items()])


def test_components_of_one_and_of_several_tasks_are_equal(spark, monkeypatch):
    rnd = random.Random(9)
    names = [bytes([rnd.randrange(256) for _ in range(4)]) for _ in range(300)]
    edges = [tuple(rnd.sample(names, 2)) for _ in range(170)] + list(zip(names[:40], names[1:41]))
    frame = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges + edges[:9]], "a binary, b binary").repartition(5)

    def rows():
        return sorted((bytes(r["node"]), bytes(r["root"])) for r in components(frame, "t").collect())
    one = rows()
    assert all(root <= node for node, root in one) and {n for n, _ in one} == {x for e in edges for x in e}
    of = dict(one)
    assert len(of) == len(one) and all(of[a] == of[b] for a, b in edges)
    monkeypatch.setattr(common, "EDGES", 30)
    assert rows() == one
