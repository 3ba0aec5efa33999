"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs from the Parquet tables to the last row; nothing is kept between queries. Each
runs once untimed at the smallest scale, so that the start of the JVM and of Python workers and
the compilation of plans are not measured.
"""

from __future__ import annotations

import json
import os
import time

from dupeframe.catalog.queries import REGISTRY
from dupeframe.session import build_session
from dupeframe.staging import drop_stages

HEADLINE = [
    "fp_sha256",
    "dup_members",
    "fp_xxh3_groups",
    "dup_members_scoped",
    "dup_members_all_tables",
    "dup_rows_lineitem",
    "dup_row_members_lineitem",
    "size_candidates",
    "cache_lookup",
    "cache_upsert",
    "cache_prune",
    "incremental_scan",
    "report_txt_lines",
    "report_json_rows_roundtrip",
    "keep_newest",
    "manual_edits",
    "violations",
    "reclaim_totals",
    "survivors",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in HEADLINE if os.path.isdir(warm) else ():
        REGISTRY[name](spark, warm).write.format("noop").mode("overwrite").save()
    drop_stages(spark)
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        drop_stages(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
