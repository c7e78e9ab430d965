"""Run a registered query next to its SQL oracle (DuckDB) and compare results.

Mirrors the acceptance check: same column names, same row count, and the same
multiset of rows (columns sorted by name, floats rounded).
"""

from __future__ import annotations

import math
import os

import pandas as pd

from ..sources.tables import TABLES


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if isinstance(v, (int, bool)):
        return int(v)
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    return str(v)


def canon(df: pd.DataFrame, digits: int = 6) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c], digits) for c in cols) for r in df[cols].to_dict("records")]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame, digits: int = 6) -> dict:
    out = {"spark_rows": len(spark_pdf), "sql_rows": len(sql_pdf),
           "spark_cols": sorted(spark_pdf.columns), "sql_cols": sorted(sql_pdf.columns)}
    out["cols_match"] = out["spark_cols"] == out["sql_cols"]
    out["rows_match"] = len(spark_pdf) == len(sql_pdf)
    if out["cols_match"] and out["rows_match"]:
        a, b = canon(spark_pdf, digits), canon(sql_pdf, digits)
        bad = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
        out["values_match"] = not bad
        if bad:
            out["first_diff"] = (a[bad[0]], b[bad[0]])
            out["n_diff"] = len(bad)
    else:
        out["values_match"] = False
    out["ok"] = out["cols_match"] and out["rows_match"] and out["values_match"]
    return out


def check(spark, name: str, sf_dir: str, queries: dict, sqls: dict, con=None, digits: int = 6) -> dict:
    sdf = queries[name](spark, sf_dir).toPandas()
    if name not in sqls:
        return {"ok": None, "spark_rows": len(sdf)}
    con = con or duck(sf_dir)
    qdf = con.execute(sqls[name]).df()
    return compare(sdf, qdf, digits)
