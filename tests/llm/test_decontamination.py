import hashlib
import random
import re

from pyspark.sql import functions as F

from riskmart.llm import decontamination as D
from tests.llm.helpers import EDGES, LONG, corpus, table


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def split(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, tests, size=10):
    wins = set()
    for i, t in tests:
        w = split(t)
        wins |= {("" if i is None else str(i), tuple(w[s:s + size])) for s in range(max(len(w) - size, 0) + 1) if w}
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for s in range(len(w)):
            for item, win in wins:
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    docs = corpus(70, 11, vocabulary=60)
    rnd = random.Random(4)
    tests = [(i, t) for i, t in enumerate(rnd.choice(docs)[1][rnd.randint(0, 60):][:rnd.randint(20, 400)] for _ in range(14))]
    tests += [(20, docs[0][1]), (20, docs[0][1]), (None, docs[1][1]), (3, None), (4, ""), (5, "... !"), (6, "A-B c"), (7, "zz yy xx"), (8, tests[0][1].upper())]
    docs += [(200, "x a.b;C y"), (201, "the the the the the the the the the the the the the")]
    tests.append((30, "the the the the the the the the the the the"))
    got = D.op1_decontamination(table(spark, docs), items(spark, tests)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, tests)
    dirty = {r["doc_id"] for r in got if r["contaminated"]}
    assert 3 < len(dirty) < len(docs)
    kept = D.clean(table(spark, docs), items(spark, tests))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - dirty and kept.columns == table(spark, []).columns


def test_edges(spark):
    tests = [(1, "word"), (2, " ".join(LONG.split()[50_000:50_030])), (3, None)]
    got = D.op1_decontamination(table(spark, EDGES), items(spark, tests)).collect()
    assert len(got) == len(EDGES)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_hit"] for r in by[7]] == [r["n_hit"] for r in by[8]] and by[7][0]["n_hit"] >= 30 and by[7][0]["n_words"] == 60_000
    assert [r["n_hit"] for r in by[6]] == [1, 1] and by[3][0]["n_words"] == 0
    assert not any(r["contaminated"] for r in D.op1_decontamination(table(spark, EDGES), items(spark, [])).collect())
    assert D.op1_decontamination(table(spark, []), items(spark, tests)).count() == 0


def test_wide_sides_are_shuffled(spark, monkeypatch):
    docs = corpus(25, 13, vocabulary=50)
    tests = [(1, docs[3][1]), (2, docs[7][1])]
    want = sorted(map(tuple, D.op1_decontamination(table(spark, docs), items(spark, tests)).collect()), key=str)
    monkeypatch.setattr("riskmart.llm.common.BROADCAST_ROWS", -1)
    assert sorted(map(tuple, D.op1_decontamination(table(spark, docs), items(spark, tests)).collect()), key=str) == want


def test_proximity(spark):
    docs = [(1, "a b c d e"), (2, "a x b c d e"), (3, "a x y b"), (4, "b a"), (5, "a a b")]
    phrases = spark.createDataFrame([("p", ["a", "b"])], "phrase string, terms array<string>")
    keys = {r["key"]: r["doc_id"] for r in table(spark, docs).select("doc_id", D.text_key(F.col("text")).alias("key")).collect()}

    def found(slack):
        return {keys[r["key"]] for r in D.near(table(spark, docs), phrases, slack).collect()}
    assert found(0) == {1, 5} and found(1) == {1, 2, 5} and found(2) == {1, 2, 3, 5}


def test_main_path_is_native(spark):
    df = D.op1_decontamination(table(spark, EDGES[:6]), items(spark, [(1, "word")]))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
