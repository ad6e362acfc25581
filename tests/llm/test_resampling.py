import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from riskmart.llm import resampling as R
from tests.llm.helpers import EDGES, corpus, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def features(text, longest=1):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def expected(docs, target, longest=1, share=(10, 100), least=20):
    """(doc_id, n_features, weight, score, rank) of every document, in plain Python."""
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t, longest)[1])
    s, t = counts([x for _, x in docs]), counts(target)
    ss, tt = sum(s.values()), sum(t.values())
    rows = []
    for i, x in docs:
        w, fs = features(x, longest)
        gains = [math.floor(1000 * math.log(((t[b] + 1) * (ss + 10_000)) / ((s[b] + 1) * (tt + 10_000)))) for b in (zlib.crc32(f.encode()) % 10_000 for f in fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): n for n, r in enumerate(able[:share[0] * len(able) // share[1]], 1)}
    return sorted((r[0], *r[1:4], ranks.get(id(r))) for r in rows if r[0] is not None)


@pytest.mark.parametrize("longest", [1, 3])
def test_equals_plain_version(spark, longest):
    docs = [*((i + 100, t) for i, t in EDGES if i is not None and i != 6 and i != 4), *((i, t) for i, t in corpus(260, 5) if i > 40)]
    target = [t for _, t in corpus(25, 6)] + [None, "", "word"]
    out = R.resample(table(spark, docs).repartition(3), items(spark, target), longest=longest, pivots=3)
    assert sorted(tuple(r)[:5] for r in out.collect()) == expected(docs, target, longest)


def test_query_columns(spark):
    docs = corpus(60, 9, length=(15, 40))
    out = R.op12_resampling(table(spark, docs), items(spark, [docs[3][1]]))
    assert dict(out.dtypes) == {c: "bigint" for c in ("doc_id", *R.ADDED)}
    assert sorted(map(tuple, out.collect())) == expected(docs, [docs[3][1]])


def test_selection_of_every_rank(spark):
    rnd = random.Random(4)
    values = [(rnd.choice([None, 1, 2, 2, 3, 7]), rnd.choice(["a", "b", None])) for _ in range(120)]
    rows = spark.createDataFrame(values, "a int, b string").repartition(4).cache()
    order = sorted(values, key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or ""))
    for k in (1, 2, 37, 60, 119, 120):
        assert R.kth_key(rows, ["a", "b"], k, pivots=2) == order[k - 1]
    for k in (0, 121):
        with pytest.raises(ValueError):
            R.kth_key(rows, ["a", "b"], k)


def test_repeated_rows_and_odd_identifiers(spark):
    text = " ".join(["same"] * 30)
    docs = [(7, text)] * 40 + [(None, text)] * 10 + [(1, None), (2, "")]
    out = [r.asDict() for r in R.resample(table(spark, docs), items(spark, ["same"])).collect()]
    assert len(out) == 52 and sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3, 4, 5]
    assert {(r["n_features"], r["weight"]) for r in out if r["doc_id"] in (1, 2)} == {(0, 0)}
    named = spark.createDataFrame([(f"d{i}", f"{t} {t}") for i, t in corpus(50, 3)], "doc_id string, text string")
    assert R.resample(named, items(spark, ["x"]), share=(1, 2), carry=("text",)).filter("rank is not null and text is not null").count() > 0


def test_empty_tables_and_clashes(spark):
    assert R.op12_resampling(table(spark, []), items(spark, ["a"])).count() == 0
    docs = corpus(30, 2)
    rows = R.op12_resampling(table(spark, docs), items(spark, [])).collect()
    assert sorted(map(tuple, rows)) == expected(docs, [])
    with pytest.raises(ValueError):
        R.resample(table(spark, docs), items(spark, []), carry=("score",))
