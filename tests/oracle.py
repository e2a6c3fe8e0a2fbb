"""DuckDB beside Spark on the driver's tables."""

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TESTDATA", "/root/testdata")


def duck(sql, sf="sf0.001"):
    con = duckdb.connect()
    for f in os.listdir(f"{DATA}/{sf}"):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{sf}/{f}'")
    return con.sql(sql).df()


def rows(pdf):
    def plain(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return None
        if isinstance(v, str) or isinstance(v, bool):
            return v
        return float(v) if isinstance(v, float) else int(v) if hasattr(v, "__int__") else v

    return sorted((tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None)), key=repr)
