"""Compare a query's rows with its SQL in DuckDB, whatever the order of rows and columns."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(v[i] for i in order) for v in values)


def difference(spark, con, query, sql, sf_dir):
    """None, or what differs."""
    df = query(spark, sf_dir)
    names, ours = rows(df.columns, map(tuple, df.collect()))
    found = con.execute(sql)
    other, theirs = rows([d[0] for d in found.description], found.fetchall())
    if names != other:
        return f"columns {names} and {other}"
    if ours != theirs:
        return f"rows {list((ours - theirs).items())[:3]} and {list((theirs - ours).items())[:3]} of {sum(ours.values())} and {sum(theirs.values())}"
    return None
