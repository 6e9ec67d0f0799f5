"""Run queries and their SQL side by side: ``python -m checks.compare [sf_dir] [name ..]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from sitesieve.session import tuned

from .queries import QUERIES, SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def main(sf_dir: str, names: list[str]) -> int:
    builder = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    spark = tuned(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            columns = sorted(frame.columns)
            ours = Counter(tuple(row[c] for c in columns) for row in frame.collect())
            spent = time.time() - start
            if name not in SQL:
                print(f"rows  {name}: {sum(ours.values())} rows {spent:.1f}s", flush=True)
                continue
            start = time.time()
            result = con.execute(SQL[name])
            found = [d[0] for d in result.description]
            order = [found.index(c) for c in columns] if sorted(found) == columns else None
            if order is None:
                raise ValueError(f"columns {columns} against {sorted(found)}")
            theirs = Counter(tuple(row[i] for i in order) for row in result.fetchall())
        except Exception as error:
            bad += 1
            print(f"ERROR {name}: {type(error).__name__} {str(error)[:600]}", flush=True)
            continue
        same = ours == theirs
        label = ("ok   " if ours else "EMPTY") if same else "DIFF "
        bad += not same or not ours
        print(f"{label} {name}: {sum(ours.values())} / {sum(theirs.values())} rows, {spent:.1f}s / {time.time() - start:.1f}s", flush=True)
        if not same:
            for row, n in list((ours - theirs).items())[:4]:
                print("   spark only", n, str(dict(zip(columns, row)))[:400])
            for row, n in list((theirs - ours).items())[:4]:
                print("   sql only  ", n, str(dict(zip(columns, row)))[:400])
    return bad


if __name__ == "__main__":
    arguments = sys.argv[1:]
    raise SystemExit(main(arguments[0] if arguments else "/root/testdata/sf0.01", arguments[1:]))
