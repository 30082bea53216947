"""Compare registered queries with their SQL: python tests/compare.py [scale dir] [name part...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, name, query, sql, sf):
    """Problem text or None, and the number of rows."""
    df = query(spark, sf)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None, len(got)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got)
    if got != want:
        a, b = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows != {len(want)} rows; only spark {a}; only sql {b}", len(got)
    return None, len(got)


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = session(), duck(sf)
    bad = []
    for name, query in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        begin = time.time()
        try:
            problem, n = check(spark, con, name, query, entry.oracle_sql().get(name), sf)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        print(f"{'ok ' if problem is None else 'BAD'} {name} {n} rows {time.time() - begin:.1f}s"
              f" {'' if name in entry.oracle_sql() else '(no sql)'} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print("failed:", bad)
