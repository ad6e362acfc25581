import zlib

import numpy as np
import pytest

from riskmart.llm.sharding import feistel_shards, numbered, op10_sharding, permute
from tests.llm.helpers import EDGES, table


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_permutation(n):
    p = permute(np.arange(n), n, 5)
    assert sorted(p.tolist()) == list(range(n))
    assert n < 50 or (p != permute(np.arange(n), n, 6)).mean() > 0.8
    assert (permute(np.array([n - 1]), n, 5) == p[-1]).all()


def test_numbers_do_not_depend_on_layout(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 as doc_id")
    a = {r[0]: r[1] for r in numbered(df.repartition(2), ["doc_id"]).collect()}
    b = {r[0]: r[1] for r in numbered(df.repartition(9), ["doc_id"]).collect()}
    assert a == b == {i: i for i in range(5000)}


def test_shards(spark):
    rows = op10_sharding(table(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    sizes = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows)
    want = sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in EDGES)
    assert sizes == want
    counts = {}
    for r in rows:
        counts.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, op10_sharding(table(spark, EDGES[::-1]).repartition(5)).collect()), key=str)


def test_many_equal_rows_and_none(spark):
    rows = op10_sharding(table(spark, [(1, "same")] * 500)).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted((i % 24, i // 24) for i in range(500))
    assert op10_sharding(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        feistel_shards(table(spark, []), ["doc_id"], 0)


def test_whole_documents_are_placed(spark, monkeypatch):
    from riskmart.llm import sharding
    docs, seen = table(spark, EDGES), []
    place = sharding.feistel_shards
    monkeypatch.setattr(sharding, "feistel_shards", lambda *a: seen.append(place(*a)) or seen[-1])
    digests = {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in op10_sharding(docs).collect()}
    placed = seen[0].collect()
    assert sorted((tuple(r["document"]) for r in placed), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert digests == {(r["doc_id"], zlib.crc32((r["document"]["text"] or "").encode()), r["shard"], r["slot"]) for r in placed}
