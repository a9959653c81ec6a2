"""Runs queries and their SQL twins side by side: ``python tests/check_queries.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value if value is None else str(value)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, v or "") for v in r))


def kinds(spark_schema, duck_description):
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    ours = {f.name: same.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_schema.fields}
    theirs = {d[0]: str(d[1]) for d in duck_description}
    return {n: (ours.get(n), theirs.get(n)) for n in ours.keys() | theirs.keys() if ours.get(n) != theirs.get(n)}


def compare(spark, con, sf_dir, plan, sql):
    """'' if the plan gives the SQL's rows, else what differs."""
    df = plan(spark, sf_dir)
    ours = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "", len(ours)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = sorted_rows(names, cursor.fetchall())
    odd = kinds(df.schema, cursor.description)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}", len(ours)
    if ours != theirs:
        only = [r for r in ours if r not in set(theirs)][:2], [r for r in theirs if r not in set(ours)][:2]
        return f"{len(ours)} / {len(theirs)} rows; {only}", len(ours)
    return (f"types {odd}" if odd else ""), len(ours)


def main() -> None:
    import __spark_entry__ as entry
    from tidemart.session import build_session
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles, failed = entry.queries(), entry.oracle_sql(), 0
    for name in wanted or queries:
        began = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        failed += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {name} {n} rows {time.time() - began:.1f}s {problem}", flush=True)
    print(f"{failed} bad of {len(wanted or queries)}")


if __name__ == "__main__":
    main()
