"""Rows of a query and of its SQL as comparable text."""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(x) -> str:
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(text, x)) + "]"
    return str(x)


def rows(found, columns) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(text(r[i]) for i in order) for r in found)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same(spark, con, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    other = con.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(other.fetchall(), other.columns)
