"""Comparing a query's rows with its SQL's rows, as values by column name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v if isinstance(v, (int, str, bool)) or v is None else str(v)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)
