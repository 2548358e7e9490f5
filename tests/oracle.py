"""Compare a registered query with its SQL counterpart in DuckDB, value for value."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def _clean(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else v
    return v


def compare(name: str, df, con, oracle: str) -> list[str]:
    """Differences as messages; empty when names, types and all values are equal."""
    problems = []
    cols = sorted(df.columns)
    rel = con.sql(oracle)
    theirs_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if cols != sorted(rel.columns):
        return [f"{name}: columns {cols} vs {sorted(rel.columns)}"]
    for c, t in df.dtypes:
        if TYPES.get(t) != theirs_types[c]:
            problems.append(f"{name}: type of {c}: {t} vs {theirs_types[c]}")
    ours = [tuple(_clean(r[c]) for c in cols) for r in df.select(*cols).collect()]
    order = [rel.columns.index(c) for c in cols]
    theirs = [tuple(_clean(r[i]) for i in order) for r in rel.fetchall()]
    if len(ours) != len(theirs):
        problems.append(f"{name}: {len(ours)} rows vs {len(theirs)}")
    a, b = sorted(ours, key=_key), sorted(theirs, key=_key)
    if a != b:
        sa, sb = set(a), set(b)
        only_a = [r for r in a if r not in sb][:3]
        only_b = [r for r in b if r not in sa][:3]
        problems.append(f"{name}: values differ\n  cols {cols}\n  ours   {only_a}\n  theirs {only_b}")
    return problems
