"""Spark against DuckDB, as the driver compares: columns by name, rows in any order, values exact."""

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value.item() if hasattr(value, "item") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(found, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(con, frame, sql):
    """None when equal, else a description of the first difference."""
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    got_columns, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if want_columns != got_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}; spark only {list(set(got) - set(want))[:2]}; sql only {list(set(want) - set(got))[:2]}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"spark {str(g)[:600]} != sql {str(w)[:600]}"
    return None if want else "EMPTY"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from sourcemart.session import build_session
    from sourcemart.checks import REGISTRY
    folder = sys.argv[1]
    keys = sys.argv[2:] or list(REGISTRY)
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for key in [k for k in REGISTRY if any(k == a or (a.endswith("*") and k.startswith(a[:-1])) for a in keys)]:
        entry, start = REGISTRY[key], time.time()
        try:
            frame = entry.run(spark, folder)
            outcome = compare(con, frame, entry.sql) if entry.sql else f"rows-only {frame.count()}"
        except Exception as error:
            outcome = f"{type(error).__name__}: {str(error)[:700]}"
        bad += outcome is not None and not outcome.startswith("rows-only")
        print(f"{key:26s} {time.time() - start:6.2f}s {'ok' if outcome is None else outcome}", flush=True)
    print("bad:", bad)
