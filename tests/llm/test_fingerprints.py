import hashlib
import random

from riskmart.llm.fingerprints import likeness, op6_fingerprints, simhash, within
from tests.llm.helpers import EDGES, corpus, table


def test_within_finds_all(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(60)]
    values = base + [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 6))) for b in base for _ in range(4)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in [*signed, *signed[:9], None]], "fp long")
    for radius, blocks in ((3, 6), (2, 4), (0, 1), (5, 8)):
        want = {(a, b) for a in signed[:40] for b in signed if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
        got = within(spark.createDataFrame([(v,) for v in signed[:40]], "fp long"), df, radius, blocks).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_near_texts_have_near_fingerprints():
    docs = [t for _, t in corpus(120, 4, copies=0, length=(60, 160))]
    other = [likeness(simhash(a), simhash(b)) for a, b in zip(docs, docs[1:])]
    near = [likeness(simhash(a), simhash(a.replace(a.split()[3], "changed", 1))) for a in docs]
    assert min(near) > 0.8 and sum(other) / len(other) < 0.65


def test_rows_against_brute_force(spark):
    docs = [*EDGES, *((i + 100, t) for i, t in corpus(80, 9))]
    rows = op6_fingerprints(table(spark, docs).repartition(7)).collect()
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in order]
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in order:
        mine = [r for r in by[i] if r["fingerprint"] == f"{simhash(t):016x}" and r["n_chars"] == len(t or "")]
        assert mine
    for k, (i, t) in enumerate(order):
        if sum(j == i for j, _ in order) > 1 or sum(j == order[(k + 1) % len(order)][0] for j, _ in order) > 1:
            continue
        own, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(own) // 2
        edited = own[:len(own) - half] + after[:half]
        r = by[i][0]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["edited_fingerprint"] == f"{simhash(edited):016x}"
        assert r["near_edited"] == likeness(simhash(own), simhash(edited)) and r["near_next"] == likeness(simhash(own), simhash(after))
        if i is not None and i % 100 == 0:
            assert r["n_near"] == sum((simhash(own) ^ simhash(x)).bit_count() <= 3 for x in texts) - 1
        else:
            assert r["n_near"] is None


def test_single_and_none(spark):
    r = op6_fingerprints(table(spark, [(100, "just one")])).first()
    assert r["near_next"] == 1.0 and r["n_near"] == 0 and r["edited_sha256"] == hashlib.sha256(b"justjust").hexdigest()
    assert op6_fingerprints(table(spark, [])).count() == 0
