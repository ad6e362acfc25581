import pytest

from riskmart.llm import suffixes as S
from tests.llm.helpers import EDGES, corpus, table


def brute(docs, passage):
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))
    own, out = {}, {}
    for d in order:
        w = (d[1] or "").encode().lower().split()
        mark = [False] * len(w)
        for s in range(len(w) - passage + 1):
            key = tuple(w[s:s + passage])
            if own.setdefault(key, d) != d:
                mark[s:s + passage] = [True] * passage
        out[d] = mark
    return out


def marks(row):
    out = [False] * row["n_words"]
    for s in row["spans"]:
        assert not any(out[s["start"]:s["end"]])
        out[s["start"]:s["end"]] = [True] * (s["end"] - s["start"])
    assert sum(out) == row["n_repeated"]
    return out


@pytest.mark.parametrize("hot,lookup,seed", [(3000, 4_000_000, 31), (2, 4_000_000, 32), (3, -1, 33)])
def test_against_brute_force(spark, monkeypatch, hot, lookup, seed):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "LOOKUP", lookup)
    docs = corpus(200, seed, vocabulary=120, copies=0.5, length=(10, 220))
    want = brute(docs, 50)
    rows = S.op9_suffix_dedup(table(spark, docs).repartition(5)).collect()
    assert len(rows) == len(docs) and sum(map(sum, want.values())) > 1000
    for r in rows:
        assert marks(r) == want[(r["doc_id"], docs[r["doc_id"]][1])], r["doc_id"]


def test_repetition_inside_a_document_stays(spark):
    docs = [(1, "same " * 300), (2, "a b c d e " * 80), (3, "x " * 10 + "a b c d e " * 30)]
    rows = {r["doc_id"]: r for r in S.op9_suffix_dedup(table(spark, docs)).collect()}
    want = brute(docs, 50)
    assert rows[1]["n_repeated"] == rows[2]["n_repeated"] == 0
    assert all(marks(rows[i]) == want[(i, t)] for i, t in docs) and rows[3]["n_repeated"] == 150


def test_edges(spark):
    rows = S.op9_suffix_dedup(table(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[7][0]["n_repeated"] == 0 and by[8][0]["n_repeated"] == by[8][0]["n_words"] == 60_000
    assert all(r["n_repeated"] == 0 for i, x in by.items() if i != 8 for r in x)
    assert S.op9_suffix_dedup(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        S.repeats(table(spark, []), 5, 6)


def test_cut(spark):
    assert S.cut(" a  b\nc d ", [(1, 3)]) == " a  d " and S.cut("a b", [(0, 2)]) == "" and S.cut("é b ü", [(2, 3)]) == "é b "
    docs = [*EDGES, *((i + 50, t) for i, t in corpus(80, 34, vocabulary=90))]
    before = table(spark, docs)
    after = S.without_repeats(before)
    assert after.columns == before.columns
    want = brute(docs, 50)
    rows = {}
    for r in after.collect():
        rows.setdefault((r["doc_id"], r["text"]), []).append(r)
    for d in set(docs):
        mark, words = want[d], (d[1] or "").split()
        if any(mark):
            assert any(k[0] == d[0] and (k[1] or '').split() == [w for w, m in zip(words, mark) if not m] and r[0]["n_chars"] == len(k[1]) for k, r in rows.items())
        else:
            assert d in rows
