"""The same rows from DuckDB."""

import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows(sql: str, sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c.execute(sql).fetch_df()


def canonical(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(map(repr, pdf[cols].astype(object).where(pdf[cols].notna(), None).values.tolist()))


def assert_same(df, sql: str, sf_dir: str) -> None:
    assert canonical(df.toPandas()) == canonical(rows(sql, sf_dir))
