"""Compare a Spark query with its SQL oracle (same rule as the driver's check:
row count, column names, order-insensitive values)."""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os

from linkloom.sources.tables import TABLES, table_path


def _norm_value(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm_value(v.item())
    return v


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm_value(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def duckdb_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = table_path(sf_dir, t)
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, sf_dir: str, query, sql: str, con=None) -> dict:
    con = con or duckdb_connect(sf_dir)
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(sql)
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    res = {"spark_rows": len(s_rows), "oracle_rows": len(o_rows),
           "schema_match": sorted(s_cols) == sorted(o_cols),
           "spark_cols": s_cols, "oracle_cols": o_cols}
    a, b = _rows(s_cols, s_rows), _rows(o_cols, o_rows)
    res["values_match"] = res["schema_match"] and a == b
    if not res["values_match"] and res["schema_match"]:
        sa, sb = set(a), set(b)
        res["only_spark"] = list(sa - sb)[:3]
        res["only_oracle"] = list(sb - sa)[:3]
    res["ok"] = res["values_match"] and len(s_rows) == len(o_rows)
    return res
