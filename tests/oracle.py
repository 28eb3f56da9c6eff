"""Compare a registered query with its SQL twin, row by row."""

import datetime as dt
import math
import pathlib

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = pathlib.Path(folder) / f"{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def compare(spark, con, name, fn, sql, folder):
    """None if both agree, else what differs."""
    df = fn(spark, folder)
    mine = table_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    theirs = table_of(columns, rel.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    wrong = [
        f"{f.name}: {f.dataType.simpleString()} != {kinds[f.name]}"
        for f in df.schema.fields if KINDS.get(f.dataType.simpleString()) != kinds[f.name]
    ]
    if wrong:
        return f"types {wrong}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return (f"{len(mine[1])} rows against {len(theirs[1])}; "
                f"only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}")
    return None
