import random

import numpy as np

from riskmart.llm.quality import FEATURES, Discriminant, op7_quality, statistics
from tests.llm.helpers import EDGES, table


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_density(spark):
    rnd = np.random.default_rng(1)
    d = len(FEATURES)
    x = {k: rnd.normal(k, 1 + k, (200, d)) for k in (0, 1)}
    m = Discriminant({k: (200.0, v.sum(0), v.T @ v) for k, v in x.items()}, to_pooled=0.2, to_diagonal=0.1)
    own = {k: np.cov(v.T) for k, v in x.items()}
    pooled = (own[0] + own[1]) / 2
    z = rnd.normal(0.5, 2, (20, d))
    logs = []
    for k in (0, 1):
        c = 0.8 * own[k] + 0.2 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-4 * np.eye(d)
        e = z - x[k].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(m.score(z), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700))), atol=1e-9)


def test_learns_and_keeps_labels_out(spark):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice(["the", "house", "stands", "over", "hills", "and", "rivers"]) for _ in range(rnd.randint(20, 60))) + "."
    bad = lambda: " ".join(rnd.choice(["buy&&", "now!!", "###", "$$$x"]) for _ in range(rnd.randint(20, 60)))
    docs = [(i, good() if i % 3 else bad()) for i in range(400)]
    labels = labelled(spark, [(i, int(i % 3 > 0), None, "x") for i in range(400)])
    rows = {r["doc_id"]: r for r in op7_quality(table(spark, docs), labels).collect()}
    held = [r for r in rows.values() if r["held_out"]]
    assert len(held) > 40 and all(r["predicted"] == int(i % 3 > 0) for i, r in rows.items())
    # labels of held-out rows change nothing
    flipped = labelled(spark, [(i, int(i % 3 == 0) if rows[i]["held_out"] else int(i % 3 > 0), 1, "x") for i in range(400)])
    again = {r["doc_id"]: r["score"] for r in op7_quality(table(spark, docs), flipped).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in rows.items())


def test_edges(spark):
    labels = labelled(spark, [(1, 1, 0, ""), (1, 0, 0, ""), (4, 0, 0, ""), (5, None, 0, ""), (None, 1, 0, ""), (7, 1, 0, "")])
    rows = op7_quality(table(spark, EDGES), labels).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in op7_quality(table(spark, EDGES), labelled(spark, [])).collect()}) == 1
    assert op7_quality(table(spark, []), labels).count() == 0
    assert statistics(None) == statistics("") == [0.0] * len(FEATURES)
