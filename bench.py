"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "A01_group_by", "A05_sum", "A14_bare_columns", "A11_distinct", "J01_inner", "J03_left", "J09_multi_way", "J12_null_aware_anti", "Q02_correlated_scalar", "Q05_in_subquery_value",
    "W01_row_number", "W12_window_aggregates", "W16_rows_frame", "W17_range_frame", "W18_groups_frame", "O05_top_k", "O06_top_k_per_group", "U02_union", "R10_deep_recursion", "F07_printf", "F24_substr", "F45_strftime", "P17_like", "S03_index_range",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from brindle.operators import registry

    queries, times = registry.queries(), {}
    queries[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()  # the session's first query pays for start-up
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 4)
    print(json.dumps({"metric": "headline queries, best of two runs each, summed", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
