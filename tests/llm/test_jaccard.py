import random

import numpy as np
import pytest

from riskmart.llm import jaccard as J
from tests.llm.helpers import EDGES, corpus, table


def sets(docs, k):
    out = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[s:s + k]) for s in range(max(len(w) - k, 0) + 1)} if w else set()))
    return out


def brute(docs, k, num, den):
    own = sets(docs, k)
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1], own[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(own):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(own)), key=str)


@pytest.mark.parametrize("k,num,den,seed", [(3, 90, 100, 21), (5, 80, 100, 22)])
def test_against_brute_force(spark, k, num, den, seed):
    docs = corpus(260, seed, copies=0.6)
    assert sorted(map(tuple, J.op2_jaccard(table(spark, docs).repartition(4), k, num, den).collect()), key=str) == brute(docs, k, num, den)


def test_chains_around_hubs(spark):
    """Copies of one text with one to four changed words, so that many pairs are just on either side of the threshold."""
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(90)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(90)] = f"x{rnd.randrange(6)}"
        docs.append((1000 - i, " ".join(w)))
    docs += [(i + 2000, " ".join(base[:40] + [f"y{i}_{j}" for j in range(50)])) for i in range(20)]
    assert sorted(map(tuple, J.op2_jaccard(table(spark, docs)).collect()), key=str) == brute(docs, 3, 90, 100)


def test_large_inputs_take_the_other_joins(spark, monkeypatch):
    docs = corpus(90, 23, copies=0.7)
    monkeypatch.setattr(J, "LOOKUP", -1)
    monkeypatch.setattr("riskmart.llm.common.BROADCAST_ROWS", -1)
    assert sorted(map(tuple, J.op2_jaccard(table(spark, docs)).collect()), key=str) == brute(docs, 3, 90, 100)


def test_a_common_passage_makes_few_pairs(spark, monkeypatch):
    """Texts that share half of their words in one passage meet in many tokens, but are no pairs to look at."""
    line = [f"c{i}" for i in range(30)]
    docs = [(i, " ".join(line + [f"d{i}_{j}" for j in range(30)])) for i in range(120)]
    docs += [(1000 + i, docs[i][1]) for i in range(5)] + [(2000 + i, docs[i][1] + " end") for i in range(5)]
    seen, real = [], J._possible
    monkeypatch.setattr(J, "_possible", lambda pairs, *rest: seen.append(pairs.distinct().count()) or real(pairs, *rest))
    assert sorted(map(tuple, J.op2_jaccard(table(spark, docs)).collect()), key=str) == brute(docs, 3, 90, 100)
    assert 0 < sum(seen) <= 2 * len(docs)


def test_parities_differ_in_no_more_places_than_sets():
    rnd = np.random.default_rng(5)
    for size in (0, 1, 40, 900):
        x = np.unique(rnd.integers(0, 1 << 64, size, np.uint64))
        for change in (0, 1, 7, 300):
            y = np.union1d(x[change:], rnd.integers(0, 1 << 64, change, np.uint64))
            bits = sum(bin((a ^ b) & (1 << 64) - 1).count("1") for a, b in zip(J.parities(x), J.parities(y)))
            assert bits <= len(np.setxor1d(x, y)) and bits % 2 == len(np.setxor1d(x, y)) % 2


def test_edges(spark):
    got = J.op2_jaccard(table(spark, EDGES)).collect()
    assert sorted(map(tuple, got), key=str) == brute(EDGES, 3, 90, 100)
    assert J.op2_jaccard(table(spark, [])).count() == 0


def test_keep_one(spark):
    docs = [*EDGES, *((i + 50, t) for i, t in corpus(120, 24, copies=0.6))]
    kept = J.keep_one(table(spark, docs))
    assert kept.columns == table(spark, []).columns
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    want = brute(docs, 5, 80, 100)
    parts = {c for _, n, c in want if n and c is not None}
    assert {i for i, t in rows if t and t.split() and i is not None} == parts
    blank = [d for d in docs if not (d[1] or "").split()]
    assert all(d in rows for d in blank)
    assert len([1 for i, t in rows if t and t.split() and i is not None]) == len(parts)
    assert J.keep_one(table(spark, [])).count() == 0
