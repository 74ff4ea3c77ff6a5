"""Row-by-row comparison of a registered query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


# Spark type names and the names DuckDB gives to the same types.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def spark_rows(df):
    names = sorted(df.columns)
    types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    rows = df.select(*names).collect()
    return [(n, types[n]) for n in names], Counter(tuple(normal(v) for v in r) for r in rows)


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    cols = [(d[0], str(d[1])) for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i][0])
    rows = Counter(tuple(normal(r[i]) for i in order) for r in cur.fetchall())
    return [cols[i] for i in order], rows
