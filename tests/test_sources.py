import json
import os

import pytest
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.operators import splits
from riskmart.session import cut_lineage, session_conf, shared_folder
from riskmart.sources import naming, readers, writers
from riskmart.streaming import landing


def test_names():
    assert naming.safe_key("/a/b/My table--1.parquet") == "My_table_1" and naming.safe_key("/x/%%%") == "table"
    assert naming.table_key("Plus-Cadastro") == "plus_cadastral" and naming.table_key("Other x") == "other_x"
    assert [naming.unique_key("a", t) for t in ([], ["a"], ["a", "a_2"])] == ["a", "a_2", "a_3"]
    assert naming.find_table({"Score_01": 1}, "score_01") == "Score_01"
    with pytest.raises(KeyError):
        naming.find_table({}, "x")
    assert naming.step_table(6) == "plus_pagamento" and naming.step_name(1) == "Score 1"
    with pytest.raises(ValueError):
        naming.step_name(9)
    assert naming.step_features(["ID_UNICO", "FPD", "x", "Flag_OOT"]) == ["x"]
    assert naming.missing_features(["a"], ["a", "b"]) == ["b"]


def test_session_settings(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"spark.sql.shuffle.partitions": 30, "other": 1}))
    conf = session_conf({"spark.x": True}, f)
    assert conf["spark.sql.shuffle.partitions"] == "30" and conf["spark.x"] == "True" and "other" not in conf
    f.write_text("{broken")
    assert session_conf(path=f) == session_conf() == session_conf(path=tmp_path / "absent.json")
    f.write_text("[1]")
    assert session_conf(path=f) == session_conf()


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = cut_lineage(spark.range(5).withColumn("x", F.rand(1)))
    assert df.count() == 5 and "ExistingRDD" in df._jdf.queryExecution().toString()


def test_folders_as_tables(spark, tmp_path):
    root = tmp_path / "data"
    spark.range(5).write.parquet(str(root / "score_01" / "deep" / "er"))
    spark.range(3).withColumn("SAFRA", F.lit(202501)).write.partitionBy("SAFRA").parquet(str(root / "Plus Telco"))
    spark.createDataFrame([(1, "a")], "n int, t string").write.option("header", True).option("sep", ";").csv(str(root / "codes"))
    spark.range(2).write.parquet(str(root / "plus telco"))
    (root / "empty").mkdir()
    tables = readers.read_all(spark, str(root), sep=";")
    assert {n: df.count() for n, df in tables.items()} == {"score_01": 5, "plus_telco": 3, "plus_telco_2": 2, "codes": 1}
    assert tables["plus_telco"].columns == ["id", "SAFRA"] and tables["codes"].dtypes == [("n", "int"), ("t", "string")]
    assert readers.read_all(spark, str(tmp_path / "none")) == {}
    with pytest.raises(readers.EmptyFolder):
        readers.read_folder(spark, str(root / "empty"))
    with pytest.raises(FileNotFoundError):
        readers.read_folder(spark, str(tmp_path / "none"))


def test_unreadable_csv_is_reported(spark, tmp_path):
    writers.write_csv(spark.range(2), str(tmp_path / "ok"))
    tables, failed = readers.read_csvs(spark, {"ok": str(tmp_path / "ok"), "gone": str(tmp_path / "gone")})
    assert list(tables) == ["ok"] and list(failed) == ["gone"]


def test_splits_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(202501, 1), (202502, 2)], "SAFRA int, x int")
    root = str(tmp_path / "s")
    writers.write_splits(splits.split_train_oot({"t": df, "u": df}), root)
    back = writers.read_splits(spark, root)
    assert set(back) == {"t", "u"} and back["t"]["oot"].collect() == [(202502, 2)]
    writers.write_splits({"v": {"treino": df}}, root)
    assert set(writers.read_splits(spark, root)["v"]) == {"treino"}
    with pytest.raises(FileNotFoundError):
        writers.read_splits(spark, str(tmp_path / "none"))


def test_rewrite_in_place_and_failed_rewrite(spark, tmp_path):
    path = str(tmp_path / "gold")
    writers.write_by_vintage(spark.createDataFrame([(202501, -5), (202502, 7)], "SAFRA int, x int"), path)
    writers.rewrite(spark, path, lambda d: d.withColumn("x", F.greatest("x", F.lit(0))), [K.VINTAGE])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(0, 202501), (7, 202502)]
    with pytest.raises(Exception):
        writers.rewrite(spark, path, lambda d: d.withColumn("x", F.raise_error("no")))
    assert spark.read.parquet(path).count() == 2
    assert [f for f in os.listdir(tmp_path) if ".old-" in f] == []


def test_one_vintage_can_be_replaced(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = lambda *r: spark.createDataFrame(list(r), "SAFRA int, x int")
    writers.write_by_vintage(rows((1, 10), (2, 20)), path)
    writers.write_by_vintage(rows((2, 21)), path, keep_others=True)
    assert sorted((r.SAFRA, r.x) for r in spark.read.parquet(path).collect()) == [(1, 10), (2, 21)]
    writers.write_by_vintage(rows((3, 30)), path)
    assert [(r.SAFRA, r.x) for r in spark.read.parquet(path).collect()] == [(3, 30)]


def test_corrections(spark):
    df = spark.createDataFrame([(-5.0, -1.0, 0), (-1.0, -1.0, 1)], "SALARIO_FUNC_PUBL double, v double, SEM_HISTORICO_RECARGA int")
    assert [tuple(r) for r in writers.correct_columns(df, amounts=["v", "zz"]).collect()] == [(0.0, 0.0, 0), (-1.0, -1.0, 1)]


def test_a_hot_vintage_is_written_as_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        df = spark.range(300_000).select("id", F.rand(1).alias("x"), F.when(F.col("id") % 3 > 0, 202501).otherwise(202502).alias("SAFRA"))
        writers.write_by_vintage(df, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [f for f in os.listdir(tmp_path / "t" / "SAFRA=202501") if f.endswith(".parquet")]
    assert len(files) > 3 and spark.read.parquet(str(tmp_path / "t")).count() == 300_000


def test_landing_takes_new_files_once(spark, tmp_path):
    src, dst, chk = (str(tmp_path / n) for n in ("src", "dst", "chk"))
    spark.range(3).coalesce(1).write.parquet(src)
    schema = spark.range(1).schema
    landing.land_and_wait(spark, src, dst, schema, chk)
    landing.land_and_wait(spark, src, dst, schema, chk)
    assert spark.read.parquet(dst).count() == 3
    spark.range(3, 5).coalesce(1).write.mode("append").parquet(src)
    landing.land_and_wait(spark, src, dst, schema, chk)
    assert sorted(r.id for r in spark.read.parquet(dst).collect()) == [0, 1, 2, 3, 4]
    assert landing.name_pattern(["a", "a"], ["b.parquet"]) == "{a*,b.parquet}"


def test_landing_by_path(spark, tmp_path):
    """A table that is a folder of part files lands whole; prefixes go by path; names are taken literally."""
    src = tmp_path / "src"
    spark.range(10).repartition(3).write.parquet(str(src / "events.parquet"))
    spark.range(10, 14).coalesce(1).write.parquet(str(src / "raw" / "a{1},x"))
    spark.range(90, 99).write.parquet(str(src / "other.parquet"))
    schema = spark.range(1).schema
    for k, (paths, want) in enumerate([(landing.name_pattern(names=["events.parquet"]), 10), (landing.name_pattern(["raw/a"]), 4),
                                       (landing.name_pattern(names=["raw/a{1},x"]), 4), (landing.name_pattern(["raw/"], ["events.parquet"]), 14)]):
        dst, chk = str(tmp_path / f"dst{k}"), str(tmp_path / f"chk{k}")
        for _ in range(2):
            landing.land_and_wait(spark, str(src), dst, schema, chk, paths=paths)
        assert spark.read.parquet(dst).count() == want


def test_the_first_file_decides_the_format(spark, tmp_path):
    root = tmp_path / "t"
    (root / "b").mkdir(parents=True)
    (root / "a-b").mkdir()
    (root / "_x").mkdir()
    for name in ("b/1.csv", "a-b/2.parquet", "_x/0.csv", "a-b/1.txt", ".h.csv"):
        (root / name).write_text("a\n1\n")
    assert readers.first_data_file(spark, str(root)).endswith("a-b/2.parquet")
    (root / "e").mkdir()
    assert readers.first_data_file(spark, str(root / "e")) is None


def test_rewrite_keeps_the_partitioning(spark, tmp_path):
    path = str(tmp_path / "k=1" / "t")
    spark.range(6).selectExpr("id", "id % 2 AS v", "id % 3 AS w").write.partitionBy("v", "w").parquet(path)
    writers.rewrite(spark, path, lambda d: d.withColumn("id", F.col("id") + 1))
    assert readers.subfolders(spark, path) == ["v=0", "v=1"] and spark.read.parquet(path).agg(F.sum("id")).first()[0] == 21
    flat = str(tmp_path / "flat")
    spark.range(3).write.parquet(flat)
    writers.rewrite(spark, flat, lambda d: d)
    assert readers.subfolders(spark, flat) == []
