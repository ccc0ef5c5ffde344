"""Running a query in Spark and its SQL in DuckDB over the same tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*names).collect())


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


def differences(spark_side, sql_side, n=5):
    (a_names, a), (b_names, b) = spark_side, sql_side
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    more, less = a - b, b - a
    return f"{sum(more.values())} rows only in Spark: {list(more)[:n]}; {sum(less.values())} only in SQL: {list(less)[:n]}" if more or less else ""
