"""Compare a Spark query with its SQL twin in DuckDB: columns, types, rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT", "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(sf_dir) / (t + '.parquet')}')")
    return con


def _canon(row):
    return tuple(
        "\0null" if v is None else ("nan" if isinstance(v, float) and math.isnan(v) else repr(v)) for v in row
    )


def compare(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    for c, t in df.dtypes:
        if KIND.get(t, t) != types[c]:
            return f"type of {c}: {t} <> {types[c]}"
    order = sorted(names)
    got = sorted(_canon(r) for r in df.select(*order).collect())
    at = [names.index(c) for c in order]
    want = sorted(_canon([r[i] for i in at]) for r in want)
    if len(got) != len(want):
        return f"{len(got)} rows <> {len(want)}; only here {sorted(set(got) - set(want))[:2]}; only there {sorted(set(want) - set(got))[:2]}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(diff)} rows differ, e.g. {diff[0]}"
    return "" if got else "both are empty"
