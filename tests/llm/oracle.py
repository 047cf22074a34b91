"""Runs a registered query and its SQL on the same tables."""

import math

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows(frame):
    out = []
    for r in frame:
        out.append(tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in r))
    return sorted(out, key=str)


def same(spark, df, sql, tables=None, sf=SMALL):
    con = duckdb.connect()
    for t in tables or {}:
        con.register(t, tables[t])
    for t in TABLES:
        if t not in (tables or {}):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(sql)
    names = sorted(x[0] for x in want.description)
    want = con.execute(f"select {', '.join(names)} from ({sql.strip()})").fetchall()
    assert sorted(df.columns) == names
    assert rows(map(tuple, df.select(*names).collect())) == rows(want)
    return want
