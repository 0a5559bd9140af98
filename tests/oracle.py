"""Side-by-side comparison of a query with its SQL."""

from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v if isinstance(v, (int, str, bool)) else str(v)


def connection(folder=DATA):
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def both(spark, con, query, sql, folder=DATA):
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert cols == sorted(names)
    return got, want
