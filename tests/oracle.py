"""Run queries beside their SQL. python tests/oracle.py SF NAME... (all without names)."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings clean_crime incident_raw tract tract_edge crime_code site panel content_label pack_spec".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if isinstance(v, (list, np.ndarray)):
            return tuple(cell(x) for x in v)
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, np.integer)):
            return f"{int(v)}"
        if isinstance(v, (float, np.floating)):
            return f"{float(v):.6g}" if v != int(v) else f"{int(v)}"
        return str(v)

    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """'' if the rows agree, else what differs."""
    a, b = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    a, b = rows(a), rows(b)
    if a == b:
        return ""
    in_a, in_b = set(a), set(b)
    extra, missing = [x for x in a if x not in in_b][:3], [x for x in b if x not in in_a][:3]
    return f"{len(a)} and {len(b)} rows; extra {extra}, missing {missing}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from parcelspark.session import local_session

    sf = sys.argv[1]
    spark, con = local_session(8), connect(sf)
    q, s = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or q:
        began = time.time()
        try:
            said = compare(spark, con, q[name], s[name], sf) if name in s else f"{q[name](spark, sf).count()} rows, no SQL"
        except Exception as e:
            said = "ERROR " + str(e)[:700]
        print(f"{name}: {said or 'ok'} ({time.time() - began:.1f} s)", flush=True)
