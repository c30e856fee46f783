"""Compare every registered query with its DuckDB statement.

    python -m marketpulse.checks.run [sf_dir] [name-part ...]
"""

from __future__ import annotations

import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def main(argv: list[str]) -> int:
    import duckdb
    import pandas as pd

    from marketpulse.checks.queries import REGISTRY
    from marketpulse.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    spark = build_session("checks", "local[8]", spark__sql__shuffle__partitions=8,
                          spark__ui__enabled="false", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name, query in REGISTRY.items():
        if parts and not any(p in name for p in parts):
            continue
        began = time.time()
        try:
            got = query.run(spark, sf_dir).toPandas()
            took = time.time() - began
            if query.sql is None:
                print(f"rows  {name:40s} {len(got):8d} {took:6.2f}s", flush=True)
                continue
            want = con.execute(query.sql).fetch_df()
            order = sorted(got.columns)
            if order != sorted(want.columns):
                raise AssertionError(f"columns {order} != {sorted(want.columns)}")
            a = got[order].astype(object).where(got[order].notna(), None).map(repr)
            b = want[order].astype(object).where(want[order].notna(), None).map(repr)
            a = a.sort_values(order).reset_index(drop=True)
            b = b.sort_values(order).reset_index(drop=True)
            if not a.equals(b):
                merged = a.merge(b, how="outer", indicator=True)
                diff = merged[merged["_merge"] != "both"]
                raise AssertionError(f"{len(a)} vs {len(b)} rows, {len(diff)} differ\n{diff.head(8).to_string()}")
            flag = "empty" if len(a) == 0 else "ok   "
            print(f"{flag} {name:40s} {len(a):8d} {took:6.2f}s", flush=True)
        except Exception as e:
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:1800]}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
