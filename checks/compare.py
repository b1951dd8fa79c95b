"""Run registered queries against their SQL twins: python -m checks.compare [sf] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import oracle_sql
from checks.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("tideline-checks")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def rows_of(values) -> list:
    return sorted(values, key=repr)


def mismatch(spark: SparkSession, con, sf: str, name: str) -> str | None:
    """None when both sides agree on column names and on all rows."""
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = rows_of(tuple(r) for r in df.select(*cols).collect())
    sql = oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = rows_of(tuple(row[i] for i in order) for row in cursor.fetchall())
    if got != want:
        only_got = list(set(got) - set(want))[:2]
        only_want = list(set(want) - set(got))[:2]
        return f"{len(got)} rows against {len(want)}; spark {only_got}; sql {only_want}"
    return None if got else "no rows"


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    chosen = argv[1:] or list(QUERIES)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf)
    bad = 0
    for name in chosen:
        started = time.time()
        try:
            problem = mismatch(spark, con, sf, name)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s "
              f"{problem or ''}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
