import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskmart.llm import alignment as A
from riskmart.llm.bpe import vocabulary
from tests.llm.helpers import EDGES, corpus, table

LEFT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LEFT.encode_special_tokens = True
LEFT.no_truncation()
LEFT.no_padding()
RIGHT = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _unicode_bytes():
    """Characters of the byte-level alphabet and their bytes, by its public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTES = _unicode_bytes()
TOKENS = {i: bytes(BYTES.get(c, 0) for c in t) for t, i in LEFT.get_vocab().items()}


def tokens(text):
    """((id, start, end) on both sides) by the libraries, empty unless both spell the text."""
    whole = b" " + (text or "").encode()
    a = LEFT.encode(" " + (text or ""), add_special_tokens=False).ids
    b = RIGHT.encode(text or "")
    out = []
    for ids, spell in ((a, TOKENS.get), (b, lambda i: A.piece_bytes(RIGHT.id_to_piece(i)))):
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(spell(i))))
            at += len(spell(i))
        out.append(side if text and b"".join(map(spell, ids)) == whole else None)
    return out if None not in out else ([], [])


def expected(docs):
    """All result rows by comparing every token with every other of its text."""
    found, counts = [], Counter()
    for i, text in docs:
        a, b = tokens(text)
        shared = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, before = [], 0
        for e in shared:
            groups.append(",".join(str(t) for t, s, x in a if before <= s and x <= e) + "|" + ",".join(str(t) for t, s, x in b if before <= s and x <= e))
            before = e
        links = [(x, y) for x, s, e in a for y, p, q in b if s < q and p < e]
        counts.update(links)
        found.append((i, len(a), len(b), groups, links))
    best = {}
    for (x, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((i, na, nb, len(g), len(ls), sum(counts[k] == best[k[1]] for k in ls), sum(counts[k] for k in ls),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for i, na, nb, g, ls in found), key=str)


def texts(n=90):
    rnd = random.Random(12)
    pool = ["a", "b", " ", "  ", "Z9", "\n", "\t", "é", "漢字", "😀", "▁", "\x00", "<s>", "</s>", "<|endoftext|>", "<0x41>", "it's", " the", " there", "ing",
            "́", "​", " ", "1234567", "...", " ,", "ß", "µ"]
    made = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return [*made, " ", "   ", "\n", "▁", "<unk>", "a" * 700, " " * 300 + "x", "漢" * 120, "word " * 60]


def test_equals_all_pairs(spark):
    docs = [*((i, t) for i, t in EDGES if not t or len(t) < 10_000), *((i + 50, t) for i, t in enumerate(texts())),
            *((i + 500, t) for i, t in corpus(30, 3, length=(2, 60)))]
    out = A.op13_alignment(table(spark, docs).repartition(3))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = sorted(map(tuple, out.collect()), key=str)
    assert rows == expected(docs) and sum(r[1] > 0 for r in rows) > 80 and sum(r[1] == 0 for r in rows) > 5


def test_shuffled_counts(spark, monkeypatch):
    docs = corpus(40, 8, length=(2, 50)) + [(900 + i, "the same few words") for i in range(60)]
    monkeypatch.setattr("riskmart.llm.common.BROADCAST_ROWS", -1)
    monkeypatch.setattr(A, "HOT", 1 / 40)
    assert sorted(map(tuple, A.op13_alignment(table(spark, docs)).collect()), key=str) == expected(docs)


def test_windows_are_aligned_once():
    a, b = A.sides(vocabulary(), A.piece_model())
    aligner = A.Aligner(a, b)
    text = "some words come again and again in some text " * 50
    pair = (a.ids(text, b" " + text.encode()), b.ids(text, b" " + text.encode()))
    first = aligner.batch([pair])
    assert aligner.aligned < 20
    made = aligner.aligned
    assert [x[0] for x in aligner.batch([pair, pair])] == [first[0][0]] * 2 and aligner.aligned == made
    little = A.Aligner(a, b, store=3000)
    assert little.batch([pair])[0][0] == first[0][0] and little.used <= 3000


def test_equal_hashes_are_told_apart(monkeypatch):
    a, b = A.sides(vocabulary(), A.piece_model())
    docs = [t for _, t in corpus(12, 4)]
    pairs = [(a.ids(t, b" " + t.encode()), b.ids(t, b" " + t.encode())) for t in docs]
    want = A.Aligner(a, b).batch(pairs)
    monkeypatch.setattr(A, "mix", lambda h: h & np.uint64(7))
    got = A.Aligner(a, b).batch(pairs)
    assert [(x[0], x[1], x[2].tolist(), x[3].tolist()) for x in got] == [(x[0], x[1], x[2].tolist(), x[3].tolist()) for x in want]


def test_long_text_groups_and_empty_table(spark):
    long = [(7, EDGES[9][1])]
    row = A.aligned(table(spark, long), keep=("groups",)).first()
    groups = [[list(map(int, x.split(","))) for x in g.split("|")] for g in row["groups"].split(";")]
    a, b = A.sides(vocabulary(), A.piece_model())
    assert [i for g in groups for i in g[0]] == a.ids(long[0][1], b" " + long[0][1].encode()).tolist()
    assert all(b"".join(a.tokens[i] for i in x) == b"".join(b.tokens[i] for i in y) for x, y in groups) and len(groups) == row["n_groups"]
    assert A.op13_alignment(table(spark, [])).count() == 0
    named = spark.createDataFrame([("x", "two words"), (None, None)], "doc_id string, text string")
    assert A.op13_alignment(named).agg(F.sum("n_a")).first()[0] == 2
