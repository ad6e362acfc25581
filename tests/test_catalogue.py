"""Every registered query against its SQL, and the shape of every plan."""

import os

import pytest

from riskmart.catalogue import load
from tests.oracle_check import compare, connect

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")
QUERIES = load()
CHECKED = [n for n, q in QUERIES.items() if q.sql]
LAZY = [n for n in QUERIES if not n.startswith(("model_", "imp_", "io_", "stream_", "sample_train", "score_populations"))]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def built(spark):
    from __spark_entry__ import queries
    return queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, built, con, name):
    assert compare(built[name](spark, FOLDER), con, QUERIES[name].sql) is None


def test_the_comparison_notices_differences(spark, con):
    df = spark.sql("SELECT 1 AS a, 2.0D AS b")
    assert compare(df, con, "SELECT 1 AS a, 2.0::DOUBLE AS b") is None
    for sql in ("SELECT 1 AS a, 2.1::DOUBLE AS b", "SELECT 1 AS a, 2.0::DOUBLE AS c", "SELECT 1::BIGINT AS a, 2.0::DOUBLE AS b",
                "SELECT 1 AS a, 2.0::DOUBLE AS b UNION ALL SELECT 1, 2.0"):
        assert compare(df, con, sql)


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_cross_join_and_no_row_python(spark, built, name):
    plan = built[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in plan
    if name != "stat_ztest_verdict":        # one pandas call on the one-row result
        assert "ArrowEvalPython" not in plan


def test_entry(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert len(df.columns) > 300 and df.count() > 0 and len(set(df.columns)) == len(df.columns)
    assert df.select("ID_UNICO").distinct().count() == df.count()


def test_names_of_both_contracts_agree():
    from __spark_entry__ import oracle_sql, queries
    assert set(oracle_sql()) <= set(queries()) and len(queries()) >= 150


def test_shuffle_parts_grow_with_the_tables_read(spark, monkeypatch):
    from __spark_entry__ import SMOKE_FOLDER
    from riskmart import session
    from riskmart.catalogue import Tables
    least, advised = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.conf.get(session.ADVISED)
    try:
        t = Tables(spark, SMOKE_FOLDER)
        t.orders, t.lineitem
        assert session.parts(spark) == least and spark.conf.get(session.ADVISED) == advised
        monkeypatch.setattr(session, "PART_BYTES", 1000)
        t = Tables(spark, SMOKE_FOLDER)
        t.orders
        first = session.parts(spark)
        t.lineitem, t.orders
        assert least < first < session.parts(spark) and session.parts(spark) == -(-sum(t._sizes.values()) // 1000)
        plan = spark.range(10_000).selectExpr("id % 7 AS k").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        assert f", {session.parts(spark)})" in plan and spark.conf.get(session.ADVISED) == str(session.TOGETHER)
    finally:
        spark.conf.unset(session.PARTS)
        spark.conf.set(session.ADVISED, advised)


def test_customers_are_dealt_out_before_they_become_wide_rows(spark, tmp_path):
    from riskmart.catalogue import Tables
    from riskmart.catalogue.roles import VINTAGES, raw_telco
    spark.range(64).selectExpr("id AS c_custkey", "CAST(id AS DOUBLE) AS c_acctbal", "CAST(id % 25 AS INT) AS c_nationkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows = raw_telco(Tables(spark, str(tmp_path)))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.count() == 64 * len(VINTAGES)
