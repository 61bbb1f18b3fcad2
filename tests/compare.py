"""Run a registered query and its SQL over the same tables and compare all values."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """Empty when both hold the same rows, else what is wrong."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} / {len(sql_df)}"
    a, b = normal(spark_df), normal(sql_df)
    types = [(c, str(a[c].dtype), str(b[c].dtype)) for c in a if a[c].dtype != b[c].dtype]
    if types:
        return f"types {types}"
    unequal = ~(a.eq(b) | (a.isna() & b.isna())).all(axis=1)
    if unequal.any():
        i = unequal.idxmax()
        return f"{unequal.sum()} rows differ, first: {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"
    return ""
