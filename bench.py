"""Seconds of the headline queries, as one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from keyweave.queries import QUERIES
from keyweave.session import session

HEADLINE = [
    "join_nbj", "join_smj", "join_ghj", "join_dhh_skew", "join_correlated_hybrid", "join_ocap_hybrid", "join_skewed_ghj", "join_skewed_dhh_skew",
    "join_skewed_correlated_hybrid", "join_hotcold", "ct_full", "partition_stats", "tpch_q01", "tpch_q03", "tpch_q05", "tpch_q09", "tpch_q12", "tpch_q18", "tpch_q21",
]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["join_ghj"](spark, d).write.format("noop").mode("overwrite").save()  # warm up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    sys.exit(main())
