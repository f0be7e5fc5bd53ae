"""Order-blind comparison of a Spark query with its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


_TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def difference(df, con, sql: str) -> str | None:
    """None when columns, types and rows agree, else what differs."""
    result = con.execute(sql)
    described = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    order = sorted(df.columns)
    if order != sorted(described):
        return f"columns {order} vs {sorted(described)}"
    types = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    wrong = {c: (types[c], described[c]) for c in order if types[c] != described[c]}
    names = list(described)
    rows = Counter(tuple(r[c] for c in order) for r in df.collect())
    want = Counter(tuple(r[names.index(c)] for c in order) for r in expected)
    if rows != want:
        return (f"{sum(rows.values())} vs {sum(want.values())} rows; only Spark {list((rows - want).items())[:2]}; "
                f"only SQL {list((want - rows).items())[:2]}; columns {order}")
    return f"types {wrong}" if wrong else None
