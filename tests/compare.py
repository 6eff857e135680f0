"""Run a query and its SQL on the same tables and compare every value."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

from hearthline.checks.sql import ORACLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return sorted(picked, key=lambda r: tuple((v is not None, str(v)) for v in r))


def spark_rows(df):
    return sorted(df.columns), _rows(df.columns, df.collect())


def oracle_rows(con, name: str):
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    return sorted(columns), _rows(columns, cursor.fetchall())


def differences(left: list[tuple], right: list[tuple]) -> list[tuple]:
    return [(a, b) for a, b in zip(left, right) if a != b or [type(v) for v in a] != [type(v) for v in b]]
