import random

import corpus_pipeline as C
from riskmart.llm import toxicity
from tests.llm.helpers import corpus, table
from tests.llm.test_bpe import expected
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_jaccard import brute as linked
from tests.llm.test_suffixes import brute as repeated


def folder(spark, path, docs, tests, labels):
    table(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(tests, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    rnd = random.Random(12)
    docs = [(None, "a text without identifier"), (900, None), (901, ""), *corpus(240, 51, copies=0.5, length=(20, 150))]
    bad = {i for i, t in docs if i is not None and i < 900 and i % 6 == 0}
    docs = [(i, t + " you stupid moron" if i in bad else t) for i, t in docs]
    tests = [(1, docs[60][1][10:200]), (2, rnd.choice(docs[10:])[1][:120]), (3, None)]
    labels = [(i, 1, int(i in bad)) for i, _ in docs if i is not None and i < 900]
    folder(spark, tmp_path, docs, tests, labels)
    sf, rows = str(tmp_path), table(spark, docs)
    assert [n for n, _ in C.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "bpe"]
    columns = rows.columns

    def pairs(df):
        assert df.columns == columns
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    one = C.drop_toxic(spark, rows, sf)
    kept = pairs(one)
    scores = {r["doc_id"]: r["score"] for r in toxicity.op4_toxicity(rows, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert kept == sorted(((i, t) for i, t in docs if scores[i] < 0.3), key=str)
    assert not [1 for i, _ in kept if i in bad] and len(kept) >= len(docs) - len(bad) - 1

    one = table(spark, kept)
    two = pairs(C.drop_near_copies(spark, one, sf))
    roots = linked(kept, 5, 80, 100)
    assert two == sorted((d for d in kept if (d[0], len(d[1] or "")) and any(r[0] == d[0] and (r[2] == r[0] or r[1] == 0) for r in roots)), key=str)

    three = pairs(C.cut_repeats(spark, table(spark, two), sf))
    marks = repeated(two, 50)
    assert [(i, (t or "").split()) for i, t in three] == [(i, [w for w, m in zip((t or "").split(), marks[(i, t)]) if not m]) for i, t in two] and len(three) == len(two)

    four = pairs(C.drop_leaks(spark, table(spark, three), sf))
    dirty = {r[0] for r in leaks(three, tests) if r[5]}
    assert dirty and four == [d for d in three if d[0] not in dirty]

    five = {r["doc_id"]: r for r in C.encode(spark, table(spark, four), sf).collect()}
    assert len(five) == len(four) and all(five[i]["ids"] == expected(t)[0] for i, t in four)

    whole = {(r["doc_id"], r["ids_sha256"]) for r in C.run(spark, sf).collect()}
    assert whole == {(r["doc_id"], r["ids_sha256"]) for r in five.values()}


def test_empty_tables(spark, tmp_path):
    folder(spark, tmp_path, [], [], [])
    assert C.run(spark, str(tmp_path)).count() == 0


def test_registered():
    from __spark_entry__ import oracle_sql, queries
    names = [n for n in queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])
    assert {"op1_decontamination", "op2_jaccard", "op11_chat", "op12_resampling"} <= set(oracle_sql())
