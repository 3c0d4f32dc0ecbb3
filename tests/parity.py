"""Compare a query's rows with its DuckDB twin, as multisets of rendered cells."""

import glob
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rendered(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, folder, query, sql, con):
    df = query(spark, folder)
    got = rendered([tuple(r) for r in df.collect()], df.columns)
    c = con.execute(sql)
    assert got == rendered(c.fetchall(), [d[0] for d in c.description])
