import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from riskmart.llm import lattice as L
from tests.llm.helpers import EDGES, corpus, table

PIECES = [(b" ", -3.0), (b" a", -2.0), (b" ab", -4.0), (b"b", -2.5), (b"ab", -3.0), (b"c", -2.0), (b"bc", -3.5), *((bytes([x]), -9.0) for x in range(256) if x not in b" bc")]


def model():
    return L.Lattice([p for p, _ in sorted(PIECES)], np.array([s for _, s in sorted(PIECES)] + [-1.0]))


def brute(lattice, word):
    """Sum over all segmentations, one by one."""
    text = L.MARK + word
    p = dict(zip(lattice.pieces, np.exp(lattice.logs)))

    @lru_cache(None)
    def rest(i):
        return 1.0 if i == len(text) else sum(p[text[i:j]] * rest(j) for j in range(i + 1, len(text) + 1) if text[i:j] in p)
    return rest(0) * math.exp(lattice.stop)


def test_marginal_and_expected_uses():
    m = model()
    words = [b"abc", b"a", b"", b"bcab", b"\xc3\xa9z", b"cccc", b"abcabcab"]
    logs = m.word_logs(words)
    assert np.allclose(logs, [math.log(brute(m, w)) for w in words])
    # uses are the derivative of the logarithm by each piece's log weight
    uses = m.uses(words)
    for k in (m.pieces.index(x) for x in (b" a", b"ab", b"b", b" ")):
        other = model()
        other.logs = m.logs.copy()
        other.logs[k] += 1e-5
        assert abs((other.word_logs(words).sum() - logs.sum()) / 1e-5 - uses[k]) < 1e-3
    assert math.isfinite(m.word_logs([b"x" * 5000])[0])


def test_mass_is_at_most_one():
    small = L.Lattice([b" ", b" a", b"a", b"b", b"ab"], np.zeros(6))
    total = sum(brute(small, bytes(w)) for n in range(9) for w in __import__("itertools").product(b"ab", repeat=n))
    assert 0.8 < total <= 1 + 1e-9


def test_vocabulary_covers_every_byte():
    pieces = dict(L.vocabulary())
    assert all(bytes([x]) in pieces for x in range(256)) and 10_000 < len(pieces) < 32_000
    assert not any(L.MARK in p[1:] for p in pieces)


def expected(docs, m, known=None):
    """Base score, counts, and the model's score from its definition, for documents as (doc_id, text)."""
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    words = [(i, L.split_words(t)) for i, t in docs]
    train = [w for i, w in words if fold(i)]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + bool(train)
    d = L.discount(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    out = []
    for i, w in words:
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        score, seen = 0.0, Counter()
        for k, x in enumerate(w):
            weight = L.REPEAT * k / (k + L.WARM)
            p = max(c[x] - d, 0) / n + d * v / n * math.exp(m.word_logs([x])[0])
            score += math.log10((1 - weight) * p + (weight * seen[x] / k if k else 0))
            seen[x] += 1
        score += math.log10((1 - L.REPEAT * len(w) / (len(w) + L.WARM)) * (len(train) - d) / n)
        out.append((i, fold(i) == 0, len(w) + 1, sum(c[x] > 0 for x in w) + bool(train), n, base, score))
    return out


@pytest.mark.parametrize("known", [0, 60, 100_000])
def test_scores_against_definition(spark, known):
    docs = [d for d in EDGES if len(d[1] or "") < 1000] + [(i + 50, t) for i, t in corpus(60, 41)]
    got = sorted(map(tuple, L.op3_lm_score(table(spark, docs).repartition(3), sorted(PIECES), known, passes=0).collect()), key=lambda r: (str(r[0]), r[2], r[6]))
    want = sorted(expected(docs, L.Lattice.initial(sorted(PIECES))), key=lambda r: (str(r[0]), r[2], r[6]))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-6, (a, b)


def test_training_raises_the_likelihood(spark):
    docs = table(spark, corpus(80, 42, copies=0))
    words = L.word_table(docs.selectExpr("true as train", "text"))
    one, three = L.train(words, sorted(PIECES), 1), L.train(words, sorted(PIECES), 4)
    own = [bytes(r[0]) for r in words.select("word").collect()]
    first = L.Lattice.initial(sorted(PIECES)).word_logs(own).sum()
    assert first < one.word_logs(own).sum() <= three.word_logs(own).sum()


def test_rare_words_go_in_bounded_batches(spark, monkeypatch):
    """Rows of rare words that are handed on a few at a time give the same scores."""
    docs = corpus(60, 12)
    whole = {tuple(r)[:5]: r.score for r in L.op3_lm_score(table(spark, docs).repartition(3), sorted(PIECES), known_words=0, passes=1).collect()}
    monkeypatch.setattr(L, "RARE_ROWS", 7)
    parts = {tuple(r)[:5]: r.score for r in L.op3_lm_score(table(spark, docs).repartition(3), sorted(PIECES), known_words=0, passes=1).collect()}
    assert whole.keys() == parts.keys() and all(math.isclose(whole[k], parts[k], rel_tol=1e-9) for k in whole)


def test_edges(spark):
    assert L.op3_lm_score(table(spark, []), sorted(PIECES)).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = L.op3_lm_score(table(spark, [(i, "never trained") for i in held]), sorted(PIECES)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["n_tokens"] == 3 and math.isfinite(r["score"]) and r["base_score"] < 1e-9 for r in rows)
    long = L.op3_lm_score(table(spark, [d for d in EDGES if len(d[1] or "") > 1000] + [(1, None)]), sorted(PIECES), 10).collect()
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in long)
