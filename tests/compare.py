"""Run a query and its SQL side by side and compare all rows."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return str(v)


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(map(_plain, r)) for r in frame[names].astype(object).itertuples(index=False)), key=repr)


def difference(spark, folder, fn, sql):
    """None when equal, else a short description."""
    import pandas as pd
    df = fn(spark, folder)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    cur = connect(folder).execute(sql)
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    (gn, gr), (wn, wr) = rows_of(got), rows_of(want)
    if gn != wn:
        return f"columns {gn} vs {wn}"
    if len(gr) != len(wr):
        return f"{len(gr)} rows vs {len(wr)}"
    for g, w in zip(gr, wr):
        if g != w:
            return f"{str(g)[:300]} vs {str(w)[:300]}"
    return None
