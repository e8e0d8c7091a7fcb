"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from rollbook.plans import registry
from rollbook.session import local_session

HEADLINE = [
    "pnl_pivot", "positions_priced", "positions_rollforward", "cash_rollforward",
    "net_step_trades", "fills_grid_assign", "processed_fills", "fills_signed",
    "price_upsert_latest", "fill_match", "order_status_update", "fill_confirmations",
    "order_numbers", "status_log", "signals_directed", "signals_throttled_all",
    "timestamps_to_update", "event_decode",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()

    def run(name: str) -> float:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    run("pnl_pivot")  # start-up and code generation are not the queries' own
    seconds = {name: run(name) for name in HEADLINE}
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": float(scale.group(1)) if scale else folder}))


if __name__ == "__main__":
    main()
