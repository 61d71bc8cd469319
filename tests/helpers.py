"""Answers of Spark and DuckDB in one form."""

from pathlib import Path


def oracle_rows(sql: str, sf_dir: str):
    """Rows of DuckDB's answer over the tables, as sorted tuples by column name, and the names."""
    import duckdb

    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    r = c.sql(sql)
    names = sorted(r.columns)
    order = [r.columns.index(n) for n in names]
    return names, sorted(repr([x[i] for i in order]) for x in r.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr([r[n] for n in names]) for r in df.collect())
