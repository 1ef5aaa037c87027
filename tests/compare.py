"""Compare a Spark query with its DuckDB statement, in any row order.

python -m tests.compare [folder] [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(spark_df, con, sql) -> str | None:
    got = rows_of(spark_df.columns, spark_df.collect())
    relation = con.sql(sql)
    want = rows_of(relation.columns, relation.fetchall())
    if sorted(spark_df.columns) != sorted(relation.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(relation.columns)}"
    kinds = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE",
             "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    for f in spark_df.schema:
        mine = f.dataType.simpleString()
        mine = names.get(mine, mine.upper())
        if mine != kinds[f.name]:
            return f"type of {f.name}: {mine} != {kinds[f.name]}"
    if got != want:
        odd = next((p for p in zip(got, want) if p[0] != p[1]), None)
        return f"{len(got)} rows != {len(want)} rows; first difference {odd}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from storelake.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = views(folder)
    sql, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sql:
                text = difference(query(spark, folder), con, sql[name])
            else:
                text = None
                print(f"     {name}: {query(spark, folder).count()} rows, no SQL")
        except Exception as error:
            text = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += text is not None
        print(f"{'BAD ' if text else 'ok  '} {name} {time.time() - start:.1f}s {text or ''}",
              flush=True)
    print("bad:", bad, "unregistered SQL:", set(sql) - set(entry.queries()))


if __name__ == "__main__":
    main()
