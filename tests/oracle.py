"""Run registered queries against their SQL oracles: python tests/oracle.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def _key(value):
    return (value is not None, str(type(value)), str(value))


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1.5e-4)
    return type(a) is type(b) and a == b


def _sorted(rows):
    # Sort on everything but floats first, so rounding noise cannot change the pairing.
    return sorted(rows, key=lambda r: (
        [_key(v) for v in r if not isinstance(v, float)],
        [v if isinstance(v, float) else 0.0 for v in r],
    ))


def compare(frame, con, sql: str):
    """(exact, message): exact rows equal as they are; message is empty if close enough."""
    names = sorted(frame.columns)
    mine = [tuple(r) for r in frame.select(*[f"`{n}`" for n in names]).collect()]
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    if sorted(theirs_names) != names:
        return False, f"columns {names} against {sorted(theirs_names)}"
    order = [theirs_names.index(n) for n in names]
    theirs = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    if len(mine) != len(theirs):
        return False, f"{len(mine)} rows against {len(theirs)}"
    mine, theirs = _sorted(mine), _sorted(theirs)
    bad = [(a, b) for a, b in zip(mine, theirs) if not all(map(_same, a, b))]
    if bad:
        return False, f"{len(bad)} of {len(mine)} rows differ, first {names}:\n  {bad[0][0]}\n  {bad[0][1]}"
    return mine == theirs, ""


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("uptake-oracle")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    import __spark_entry__ as contract

    sf = argv[0] if argv else "0.01"
    directory = f"{DATA}/sf{sf}"
    chosen = argv[1:] or list(contract.queries())
    spark, con = session(), connect(directory)
    failed = 0
    for name in chosen:
        started = time.time()
        sql = contract.oracle_sql().get(name)
        try:
            frame = contract.queries()[name](spark, directory)
            if sql is None:
                exact, message = True, ""
                print(f"rows  {name} {frame.count()} rows")
                continue
            exact, message = compare(frame, con, sql)
        except Exception as error:  # report and go on with the next query
            exact, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        status = "FAIL" if message else ("ok" if exact else "near")
        failed += bool(message)
        print(f"{status:5} {name} {time.time() - started:.1f}s {message}", flush=True)
    print(f"{failed} failed of {len(chosen)}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
