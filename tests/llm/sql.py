"""Rows of a query and of its SQL, in one order, from the same tables."""

import math
from pathlib import Path

import duckdb


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return sorted(picked, key=lambda r: tuple((v is not None, str(v)) for v in r))


def both(spark, query, oracle: str, sf_dir: str):
    """(columns, rows) of the query, and of its SQL."""
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(oracle)
    names = [d[0] for d in cursor.description]
    df = query(spark, sf_dir)
    return (sorted(df.columns), _sorted(df.columns, df.collect())), (sorted(names), _sorted(names, cursor.fetchall()))
