"""Runs registered queries beside their oracles: ``python -m tests.compare DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(directory: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, build, sql: str, directory: str) -> str | None:
    df = build(spark, directory)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"spark {g!r}\n   oracle {w!r}"
    return None if got else "both empty"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tidewire.session import build_session

    directory, only = sys.argv[1], set(sys.argv[2:])
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(directory), oracle_sql(), []
    for name, build in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, build, sqls[name], directory)
            else:
                problem = None if build(spark, directory).count() else "no rows"
        except Exception as failure:
            problem = "".join(traceback.format_exception_only(failure))[:1500]
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
        bad += [name] if problem else []
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
