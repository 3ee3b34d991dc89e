"""Runs a registered query and its SQL twin on the same tables and compares their rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    ran = con.execute(sql)
    names = [d[0] for d in ran.description]
    assert sorted(df.columns) == sorted(names), name
    assert got == rows(names, ran.fetchall()), name
