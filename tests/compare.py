"""Run registered queries and their SQL side by side: python tests/compare.py [sf dir] [name ...]"""

import hashlib
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def shown(value):
    if value is None or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, float):
        return repr(int(value)) if value == int(value) else f"{value:.9g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(row[i]) for i in order) for row in rows)


def check(spark, con, name, query, sql, sf_dir):
    start = time.time()
    df = query(spark, sf_dir)
    mine = df.collect()
    took = time.time() - start
    if sql is None:
        return True, f"rows-only {len(mine)} rows {took:.1f}s"
    start = time.time()
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = result.fetchall()
    sql_took = time.time() - start
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    a, b = rows_of(df.columns, mine), rows_of(columns, theirs)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return False, f"{len(a)} / {len(b)} rows\n   spark {only_a}\n   sql   {only_b}"
    digest = hashlib.md5(repr(a).encode()).hexdigest()[:8]
    return True, f"{len(a)} rows {digest} {took:.1f}s (sql {sql_took:.1f}s)"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args or queries:
        try:
            good, note = check(spark, con, name, queries[name], oracle.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            good, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        failed += not good
        print("ok  " if good else "FAIL", name, note, flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
