"""Times the SQL of the headline queries in DuckDB on the same tables: median of five runs after a warm-up run."""

from __future__ import annotations

import json
import os
import statistics
import time

import duckdb

from bench import HEADLINES
from folioquery import registry


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    con, times = duckdb.connect(config={"threads": int(cpus)}), {}
    for file in sorted(os.listdir(folder)):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    for name in HEADLINES:
        if name in registry.SQL:
            runs = []
            for _ in range(6):
                begin = time.time()
                con.sql(registry.SQL[name]).to_arrow_table()
                runs.append(time.time() - begin)
            times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "duckdb_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
