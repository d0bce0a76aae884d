"""Runs a query and its SQL twin and compares their rows, whatever the order."""

import math
import os

import duckdb
import pandas as pd


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v) -> str:
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        text = f"{float(v):.5f}" if isinstance(v, float) else str(v)
        return text[:-6] if text.endswith(".00000") else text

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def connect(sf_dir: str):
    base = duckdb.connect()
    for name in os.listdir(sf_dir):
        base.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return base


def same(spark_frame: pd.DataFrame, sql: str, sf_dir: str) -> None:
    twin = connect(sf_dir).sql(sql).df()
    assert sorted(spark_frame.columns) == sorted(twin.columns)
    assert rows(spark_frame) == rows(twin)
