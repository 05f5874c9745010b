"""Runs a query and its SQL and compares the rows without regard to order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def compare(df, sql, sf_dir):
    cols = sorted(df.columns)
    got = norm(tuple(r) for r in df.select(*cols).collect())
    want = connect(sf_dir).sql(sql)
    assert sorted(want.columns) == cols
    want = norm(want.select(*cols).fetchall())
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:3]
