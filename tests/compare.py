"""Runs a registered query in Spark and its check in DuckDB and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, q, sf_dir):
    df = q.run(spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(word in plan for word in ("EvalPython", "InPandas", "MapInArrow")):
        return 0, "the plan runs Python code"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return len(got), "rows only"
    res = con.execute(q.oracle())
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return len(got), f"columns differ: {sorted(df.columns)} / {sorted(names)}"
    if got != want:
        in_want, in_got = set(want), set(got)
        extra = [r for r in got if r not in in_want][:3]
        missing = [r for r in want if r not in in_got][:3]
        return len(got), f"rows differ: {len(got)} / {len(want)}\n   spark only {extra}\n   check only {missing}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kinds = {n: str(t) for n, t in zip(names, con.execute("DESCRIBE " + q.oracle()).fetchall())}
    bad = []
    for n in names:
        spark_kind, duck = types[n], eval_kind(kinds[n])
        if spark_kind != duck:
            bad.append((n, spark_kind, duck))
    return len(got), "ok" if not bad else f"types differ: {bad}"


_MAP = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date", "HUGEINT": "hugeint", "FLOAT": "float",
}


def eval_kind(described: str) -> str:
    name = described.split("'")[3]
    return _MAP.get(name, name)
