"""Runs registered queries against their SQL on DuckDB: names, types, row counts and exact values.

    python tests/oracle_check.py [folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    out = {}
    for c in df.columns:
        out[c] = df[c].map(lambda v: "\0" if v is None or v is pd.NaT or (isinstance(v, float) and v != v)
                           else (repr(v + 0.0) if isinstance(v, float) else str(v)))
    text = pd.DataFrame(out)
    return text.sort_values(list(text.columns)).reset_index(drop=True) if len(text.columns) else text


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else a description of the first difference."""
    rel = con.sql(sql)
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    ours = {n: KINDS.get(t, t.upper()) for n, t in spark_df.dtypes}
    if set(ours) != set(theirs):
        return f"columns: only spark {sorted(set(ours) - set(theirs))}, only sql {sorted(set(theirs) - set(ours))}"
    types = {c: (ours[c], theirs[c]) for c in ours if ours[c] != theirs[c]}
    rows = spark_df.select(*sorted(spark_df.columns)).collect()
    a = pd.DataFrame([tuple(r) for r in rows], columns=sorted(spark_df.columns), dtype=object)
    got = rel.fetchall()
    b = pd.DataFrame(got, columns=rel.columns, dtype=object)
    if len(a) != len(b):
        return f"rows: spark {len(a)}, sql {len(b)}"
    if len(a) == 0:
        return "both sides are empty"
    x, y = _canonical(a), _canonical(b)
    if not x.equals(y):
        bad = (x != y)
        first = bad.any(axis=1).idxmax()
        cols = list(x.columns[bad.any()])
        show = cols[:6]
        return (f"values differ in {bad.any(axis=1).sum()} rows, columns {cols[:12]}; first: spark "
                f"{x.loc[first, show].to_dict()} sql {y.loc[first, show].to_dict()}")
    return f"types: {types}" if types else None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(folder)
    built, sql = queries(), oracle_sql()
    names = [n for n in built if not argv[1:] or any(n == w or n.startswith(w + "_") for w in argv[1:])]
    failed = 0
    for n in names:
        start = time.time()
        try:
            df = built[n](spark, folder)
            if n in sql:
                problem = compare(df, con, sql[n])
            else:
                rows = df.count()
                problem = None if rows else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(e))[:700]
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {n:32s} {time.time() - start:6.2f}s {'' if n in sql else '(rows) '}{problem or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
