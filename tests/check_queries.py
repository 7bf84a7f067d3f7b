"""Compare every registered query with its SQL: ``python tests/check_queries.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if pd.isna(x):
            return None
        if isinstance(x, pd.Timestamp):
            return x.to_pydatetime()
        x = x.item() if hasattr(x, "item") else x
        return float(x) if isinstance(x, int) else x

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(cell(x) for x in row) for row in frame.itertuples(index=False)), key=repr)


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = sf if "/" in sf else f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            ours = queries[name](spark, sf_dir).toPandas()
            took = time.time() - began
            theirs = con.sql(oracles[name]).df() if name in oracles else None
        except Exception as error:  # report and go on to the next query
            failed += 1
            print(f"ERROR {name}: {str(error)[:1500]}")
            continue
        if theirs is None:
            print(f"rows  {name}: {len(ours)} rows, {took:.2f} s")
            continue
        a, b = canonical(ours), canonical(theirs)
        # Integer columns with NULLs become floats on one side only.
        kinds = [
            {c: (f[c].dtype.kind, f[c].dtype.kind == "M" or f[c].dtype.itemsize) for c in f if not f[c].isna().any()}
            for f in (ours, theirs)
        ]
        same = kinds[0] == kinds[1] and a == b
        failed += not same
        print(f"{'ok   ' if same else 'DIFF '} {name}: {len(a)} rows, {took:.2f} s")
        if not same:
            print("  spark", dict(ours.dtypes), "\n  sql  ", dict(theirs.dtypes))
            odd = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print("  lengths", len(a), len(b), "first differences", odd)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
