import os

import pytest
from pyspark.sql import functions as F

from riskmart.sources import versions as V


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "SAFRA int, x int")


def rows(df):
    return sorted((r.SAFRA, r.x) for r in df.collect())


def test_a_reader_keeps_its_table_while_it_is_corrected(spark, tmp_path):
    root = str(tmp_path / "gold")
    with pytest.raises(FileNotFoundError):
        V.read(spark, root)
    assert V.publish(table(spark, (1, -5), (2, 7)), root, ["SAFRA"]) == 1
    before = V.read(spark, root)
    seen = []

    def change(df):
        seen.append(rows(V.read(spark, root + "/")))
        return df.withColumn("x", F.greatest("x", F.lit(0)))
    assert V.correct(spark, root, change) == 2
    assert seen == [[(1, -5), (2, 7)]] and rows(before) == seen[0] and rows(V.read(spark, root, 1)) == seen[0]
    assert rows(V.read(spark, root)) == [(1, 0), (2, 7)]
    assert V.version(spark, root).partition_by == ("SAFRA",)
    assert sorted(x for x in os.listdir(V.version(spark, root).path) if "=" in x) == ["SAFRA=1", "SAFRA=2"]


def test_failed_and_late_writers_leave_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    V.publish(table(spark, (1, 1)), root)
    with pytest.raises(Exception):
        V.correct(spark, root, lambda df: df.withColumn("x", F.raise_error("no")))

    def overtaken(df):
        V.publish(table(spark, (1, 2)), root)
        return df.withColumn("x", F.lit(3))
    with pytest.raises(V.VersionConflict):
        V.correct(spark, root, overtaken)
    assert V.versions(spark, root) == [1, 2] and rows(V.read(spark, root)) == [(1, 2)]
    assert len(os.listdir(f"{root}/data")) == 2
    assert [x for x in os.listdir(f"{root}/log") if not x.startswith(".")] and not [x for x in os.listdir(f"{root}/log") if x.startswith("new-")]


def test_old_versions_expire(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(12):
        V.publish(table(spark, (1, i)), root)
    assert V.expire(spark, root, 3) == list(range(1, 10)) and V.expire(spark, root, 3) == []
    assert V.versions(spark, root) == [10, 11, 12] and len(os.listdir(f"{root}/data")) == 3
    assert rows(V.read(spark, root, 10)) == [(1, 9)]
    with pytest.raises(FileNotFoundError):
        V.read(spark, root, 1)
    with pytest.raises(ValueError):
        V.expire(spark, root, 0)


def test_empty_table_and_change_of_partitioning(spark, tmp_path):
    root = str(tmp_path / "t")
    V.publish(table(spark).limit(0), root)
    assert V.read(spark, root).count() == 0 and V.read(spark, root).columns == ["SAFRA", "x"]
    V.publish(table(spark, (1, 1)), root)
    V.correct(spark, root, lambda df: df, ["SAFRA"])
    assert V.version(spark, root).partition_by == ("SAFRA",) and V.version(spark, root, 2).partition_by == ()
