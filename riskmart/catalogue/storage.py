"""Sources and sinks: every query writes, reads back and returns what was stored."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskmart.catalogue import query
from riskmart.models import estimators as E
from riskmart.operators import splits
from riskmart.session import cut_lineage, shared_folder
from riskmart.sources import readers, versions, writers
from riskmart.streaming import landing


def _folder(t, name: str) -> str:
    """A new folder below the session's shared folder."""
    return f"{shared_folder(t.spark).rstrip('/')}/riskmart/{name}-{uuid.uuid4().hex}"


@query("io_round_trip", "SELECT * FROM orders")
def _(t):
    path = _folder(t, "orders")
    writers.write_parquet(t.orders, path)
    return readers.read_parquet(t.spark, path)


@query("io_by_vintage", """
SELECT l_orderkey, l_partkey, l_linenumber, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS SAFRA FROM lineitem""")
def _(t):
    path = _folder(t, "lineitem")
    writers.write_by_vintage(t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("SAFRA")), path)
    return readers.read_parquet(t.spark, path)


@query("io_by_month", """
SELECT event_id, CAST(ts AS DATE) AS dia, value, CAST(year(ts) AS INTEGER) AS ano, CAST(month(ts) AS INTEGER) AS mes FROM events""")
def _(t):
    path = _folder(t, "events")
    writers.write_by_month(t.events.select("event_id", F.to_date("ts").alias("dia"), "value"), path, "dia", "ano", "mes")
    return readers.read_parquet(t.spark, path)


@query("io_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = _folder(t, "customer")
    writers.write_csv(t.customer, path)
    return readers.read_csv(t.spark, path, schema=t.customer.schema.simpleString()[7:-1].replace(":", " "))


@query("io_csv_inferred", "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(t):
    path = _folder(t, "supplier")
    writers.write_csv(t.supplier, path)
    tables, failed = readers.read_csvs(t.spark, {"supplier": path, "absent": path + "-absent"})
    assert list(failed) == ["absent"]
    return tables["supplier"]


@query("io_folder_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders UNION ALL SELECT n_nationkey, n_regionkey, 0 FROM nation")
def _(t):
    root = _folder(t, "data")
    writers.write_parquet(t.orders, f"{root}/Plus Recarga/part-a")
    writers.write_csv(t.nation, f"{root}/plus_telco")
    tables = readers.read_all(t.spark, root)
    nation = tables["plus_telco"].select(F.col("n_nationkey").cast("bigint").alias("o_orderkey"), F.col("n_regionkey").cast(
        "bigint").alias("o_custkey"), F.lit(0.0).alias("o_totalprice"))
    return tables["plus_recarga"].select("o_orderkey", "o_custkey", "o_totalprice").unionByName(nation)


@query("io_splits", """
SELECT o_orderkey, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS SAFRA,
       CASE WHEN year(o_orderdate) * 100 + month(o_orderdate) IN (200101, 200102) THEN 'oot' ELSE 'treino' END AS split FROM orders""")
def _(t):
    df = t.orders.select("o_orderkey", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("SAFRA"))
    root = _folder(t, "splits")
    writers.write_splits(splits.split_train_oot({"score_01": df}, [200101, 200102]), root)
    pair = writers.read_splits(t.spark, root)["score_01"]
    return pair["treino"].withColumn("split", F.lit("treino")).unionByName(pair["oot"].withColumn("split", F.lit("oot")))


@query("io_rewrite", """
SELECT c_custkey, CASE WHEN c_acctbal < -1 THEN 0.0 ELSE c_acctbal END AS SALARIO_FUNC_PUBL FROM customer""")
def _(t):
    path = _folder(t, "gold")
    writers.write_parquet(t.customer.select("c_custkey", F.col("c_acctbal").alias("SALARIO_FUNC_PUBL")), path)
    writers.rewrite(t.spark, path, lambda df: writers.correct_columns(df).withColumn(
        "SALARIO_FUNC_PUBL", F.col("SALARIO_FUNC_PUBL").cast("double")))
    return readers.read_parquet(t.spark, path)


@query("io_versions", """
SELECT c_custkey, 1 AS version, CAST(c_acctbal AS DOUBLE) AS SALARIO_FUNC_PUBL FROM customer
UNION ALL SELECT c_custkey, 2, CAST(CASE WHEN c_acctbal < -1 THEN 0.0 ELSE c_acctbal END AS DOUBLE) FROM customer""")
def _(t):
    root = _folder(t, "versions")
    versions.publish(t.customer.select("c_custkey", F.col("c_acctbal").cast("double").alias("SALARIO_FUNC_PUBL")), root)
    versions.correct(t.spark, root, writers.correct_columns)
    first, second = (versions.read(t.spark, root, n).withColumn("version", F.lit(n)) for n in versions.versions(t.spark, root))
    return first.unionByName(second)


@query("io_reports", "SELECT l_returnflag AS feature, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(t):
    root = _folder(t, "reports")
    writers.write_reports({"importance": t.lineitem.groupBy(F.col("l_returnflag").alias("feature")).agg(F.count("*").alias("n"))}, root)
    return readers.read_csv(t.spark, f"{root}/importance", schema="feature string, n bigint")


@query("io_literal_rows", """
SELECT r_regionkey, r_name FROM region UNION ALL SELECT -1, 'NAO SE APLICA' UNION ALL SELECT -1, 'NAO SE APLICA'""")
def _(t):
    from riskmart.operators.frames import literal_rows
    rows = literal_rows(t.spark, [(-1, "NAO SE APLICA")] * 2, t.region)
    return t.region.unionByName(rows)


@query("io_model")
def _(t):
    from riskmart.catalogue.modelling import FEATURES, line_table
    df = cut_lineage(line_table(t))
    model = E.fit("lr", df, FEATURES)
    path = _folder(t, "model")
    writers.write_final_model({"etapa_6_regressao_logistica": model}, path, 6)
    return E.score(writers.read_model(path), df, keep=["id"])


@query("stream_ingest", "SELECT * FROM events")
def _(t):
    target = _folder(t, "landing")
    schema = t.events.schema
    # the second run finds nothing new: every event lands once
    for _ in range(2):
        landing.land_and_wait(t.spark, t.folder, target, schema, f"{target}-checkpoint", paths=landing.name_pattern(names=["events.parquet"]))
    return readers.read_parquet(t.spark, target)


@query("external_sql", "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_orderstatus")
def _(t):
    readers.register({"gold_orders": t.orders})
    return t.spark.sql("SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total "
                       "FROM gold_orders GROUP BY o_orderstatus")
