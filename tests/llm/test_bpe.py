import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from riskmart.llm.bpe import Encoder, chunk_borders, encode, op8_bpe, vocabulary
from tests.llm.helpers import EDGES, corpus, table

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY.no_truncation()
LIBRARY.no_padding()


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def texts():
    rnd = random.Random(8)
    pool = "ab Z9'  \n\t .,é漢😀 \u0085​́١Ⅷ_-<|>\x00\x1c"
    out = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 300))) + "<|endoftext|>" * (i % 3 == 0) + "it's 'LL we'd x" * rnd.randint(0, 9)
           for i in range(200)]
    return [*out, " " * 5000 + "x", "a" * 3000, "\n" * 999, "<|endoftext|><|endoftext|>", "é" * 2000, "word " * 5000, *(t for _, t in corpus(40, 2, length=(300, 900)))]


def test_equals_the_library():
    encoder = Encoder(vocabulary(), store=20_000)
    for t in [*texts(), None, ""]:
        ids = encoder.ids(t)
        want, decoded = expected(t)
        assert np.frombuffer(ids, "<u4").tolist() == want and encoder.text(ids) == decoded
    assert encoder.used <= 20_000


def test_borders_follow_content():
    rnd = random.Random(1)
    body = bytes(rnd.choice(b"abcdefgh ") for _ in range(30_000))
    a, b = chunk_borders(body), chunk_borders(b"0123456789" * 50 + body)
    assert len(set(x + 500 for x in a) & set(b)) > len(a) - 3 and a[-1] == len(body)
    encoder = Encoder(vocabulary())
    encoder.ids(body.decode())
    first = encoder.encoded
    encoder.ids("new start " + body.decode())
    assert encoder.encoded - first <= 3


def test_rows(spark):
    docs = [*EDGES, *((i + 50, t) for i, t in enumerate(texts()))]
    rows = op8_bpe(table(spark, docs).repartition(3)).collect()

    def line(i, t):
        ids, decoded = expected(t)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
    assert sorted(map(tuple, rows), key=str) == sorted((line(i, t) for i, t in docs), key=str)
    kept = {r["doc_id"]: r for r in encode(table(spark, docs[-30:]), keep=("ids", "decoded")).collect()}
    assert all((kept[i]["ids"], kept[i]["decoded"]) == expected(t) for i, t in docs[-30:])
    assert op8_bpe(table(spark, [])).count() == 0
