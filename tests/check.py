"""Compare registered queries with their SQL in DuckDB: python tests/check.py [folder] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normalize(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(normalize(v) for v in value)
    return value


def difference(spark_df, con, sql):
    """None when columns and rows agree, otherwise a short description."""
    result = con.execute(sql)
    theirs = [d[0] for d in result.description]
    mine = spark_df.columns
    if sorted(mine) != sorted(theirs):
        return f"columns {sorted(mine)} != {sorted(theirs)}"
    order = sorted(mine)
    right = [tuple(normalize(row[theirs.index(c)]) for c in order) for row in result.fetchall()]
    left = [tuple(normalize(row[c]) for c in order) for row in spark_df.collect()]
    key = lambda row: tuple((v is None, str(type(v)) if v is None else "", str(v)) for v in row)
    left.sort(key=key)
    right.sort(key=key)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}; {left[:2]} {right[:2]}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ ({order}): {wrong[:3]}"
    types = [type(a).__name__ + "/" + type(b).__name__ for row in zip(left, right) for a, b in zip(*row)
             if a is not None and type(a) is not type(b)]
    return f"types {sorted(set(types))}" if types else None


def session(cores="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not sys.argv[2:] or any(q == w or (w.endswith("*") and q.startswith(w[:-1])) for w in sys.argv[2:])]
    spark, con, bad = session(), connect(folder), 0
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                status = "ok" if problem is None else "DIFF " + problem
            else:
                status = f"rows {df.count()} (no SQL)"
        except Exception as error:  # report and go on with the next query
            status = "FAIL " + str(error)[:1500]
        bad += status.startswith(("DIFF", "FAIL"))
        print(f"{name:45s} {time.time() - start:6.1f}s {status[:1800]}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")


if __name__ == "__main__":
    main()
