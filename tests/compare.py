"""Run queries and their SQL side by side: ``python -m tests.compare [sf] [name ...]``."""

from __future__ import annotations

import decimal
import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from __spark_entry__ import oracle_sql, queries

ROOT = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def make_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veilspan-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call sites for error messages cost several JVM round trips per column operation.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[bool, str]:
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(oracle_sql()[name])
    theirs_columns = [d[0] for d in result.description]
    if sorted(theirs_columns) != columns:
        return False, f"columns {columns} against {sorted(theirs_columns)}"
    types = {d[0]: str(d[1]) for d in result.description}
    place = [theirs_columns.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in place) for r in result.fetchall())
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    note = " ".join(f"{c}:{kinds[c]}/{types[c]}" for c in columns)
    if mine != theirs:
        extra, lost = list((mine - theirs).items()), list((theirs - mine).items())
        return False, (
            f"{sum(mine.values())} rows against {sum(theirs.values())}; only here {len(extra)}: "
            f"{str(extra[:2])[:700]}; only there {len(lost)}: {str(lost[:2])[:700]} [{note}]"
        )
    return True, f"{sum(mine.values())} rows [{note}]"


def main(args: list[str]) -> int:
    sf = args[0] if args else "sf0.001"
    names = args[1:] or list(queries())
    sf_dir = f"{ROOT}/{sf}"
    spark, con = make_session(), connect(sf_dir)
    spark.conf.set("spark.veilspan.partitions", "8")
    bad = 0
    for name in names:
        began = time.time()
        try:
            if name in oracle_sql():
                ok, note = compare(spark, con, sf_dir, name)
            else:
                ok, note = True, f"{queries()[name](spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # report and go on with the next
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, f"{time.time() - began:.1f}s", note, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
