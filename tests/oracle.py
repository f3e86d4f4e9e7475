"""Comparison of a query with its SQL over the driver's tables."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def key(row):
    return tuple((v is not None, "" if isinstance(v, (int, float)) else str(type(v)), str(v)) for v in row)


def both(spark, query, sql, sf_dir=SF_DIR):
    """Sorted rows of the query and of the SQL, columns by name."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    got = con.execute(sql)
    order = [[x[0] for x in got.description].index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=key)
    return ours, theirs
