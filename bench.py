"""Headline timings as one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Lines made from `events` are stored once (`ingest_*`, with lines per second), then the named
queries run on the stored tables. `parse_*` reads, parses and throws the rows away. Each figure
is the better of two runs.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from weblens.formats import FORMATS
from weblens.functions import repository_of
from weblens.operators import catalog, correlate, parse as p, timeline, traffic
from weblens.plans import adhoc
from weblens.plans.ingest import LogStore
from weblens.plans.samples import sample_files, sample_lines, write_files
from weblens.session import session, shared_folder
from weblens.streaming import live

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
START, END = dt.datetime(2024, 1, 10, 6), dt.datetime(2024, 1, 12, 18, 30)


def timed(run: Callable[[], object], times: int = 2) -> float:
    best = float("inf")
    for _ in range(times):
        began = time.monotonic()
        run()
        best = min(best, time.monotonic() - began)
    return round(best, 3)


def drain(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session(
        f"local[{CPUS}]", app="bench", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    rates: dict[str, int] = {}

    folders = {}
    for name in ("nginx", "nexus"):
        folders[name] = shared_folder(spark, "bench-logs")
        # Rotated logs: one file per stretch of time.
        lines = sample_lines(spark, SF_DIR, name).repartitionByRange(int(CPUS), "event_id")
        lines.select("line").write.text(folders[name])
        raw = spark.read.text(folders[name])
        seconds[f"parse_{name}"] = timed(lambda: drain(p.parse(raw, FORMATS[name])))
        rates[f"parse_{name}"] = round(raw.count() / seconds[f"parse_{name}"])

    store = LogStore(spark, shared_folder(spark, "bench-store"))
    for name, folder in folders.items():
        reports = []
        seconds[f"ingest_{name}"] = timed(
            lambda: reports.append(store.ingest(folder, name, globs=["part-*"], fresh=True)))
        rates[f"ingest_{name}"] = round(reports[-1].lines / seconds[f"ingest_{name}"])

    # The other ways in: appended, from zip and nested archives, counted on the stream.
    grown = LogStore(spark, shared_folder(spark, "bench-store"))
    seconds["append_nginx"] = timed(lambda: grown.ingest(folders["nginx"], "nginx", globs=["part-*"]))
    for kind in ("zip", "nested"):
        packed = write_files(sample_files(sample_lines(spark, SF_DIR, "nginx"), kind))
        seconds[f"ingest_{kind}"] = timed(lambda: grown.ingest(packed, "nginx"))

    def stream() -> None:
        counts = live.WindowCounts(spark, shared_folder(spark, "bench-windows"), FORMATS["nginx"], [(3600, 3600), (3600, 900)], ["status_code"])
        live.count_windows(counts, folders["nginx"], shared_folder(spark, "bench-stream"), ["part-*"]).awaitTermination()
    seconds["stream_window_counts"] = timed(stream)

    tables = store.tables()
    nginx, nexus = tables.values()
    for name, logs in tables.items():
        logs.createOrReplaceTempView(name)
    # Each run plans anew: a frame run twice would reuse the shuffle files of the first time.
    runs: dict[str, Callable[[], object]] = {
        "file_statistics": lambda: store.file_statistics("nginx").collect(),
        "ingest_statistics": lambda: store.statistics().collect(),
        "nginx_preview": lambda: store.preview("nginx").collect(),
        "nexus_preview": lambda: store.preview("nexus").collect(),
        "quick_statistics": lambda: store.quick_statistics().collect(),
        "requests_as_of": lambda: drain(timeline.requests_as_of(nginx, nexus)),
        "request_pairs": lambda: drain(timeline.request_pairs(nginx, nexus)),
        "requests_in_flight": lambda: drain(timeline.requests_in_flight(nexus, repository_of(F.col("path")), "repository")),
        "client_sessions": lambda: drain(timeline.client_sessions(nginx)),
        "nginx_traffic_cube": lambda: traffic.traffic_cube(nginx).collect(),
        "nginx_top_paths": lambda: traffic.top_paths(nginx).collect(),
        "nginx_top_clients": lambda: traffic.top_clients(nginx).collect(),
        "nginx_status_distribution": lambda: traffic.status_distribution(nginx).collect(),
        "nginx_method_distribution": lambda: traffic.method_distribution(nginx).collect(),
        "nginx_size_by_method_and_status": lambda: traffic.size_by_method_and_status(nginx).collect(),
        "nginx_time_range": lambda: store.time_range("nginx", START, END).collect(),
        "nexus_time_range": lambda: store.time_range("nexus", START, END).collect(),
        "nexus_top_repositories": lambda: traffic.top_repositories(nexus).collect(),
        "nexus_user_activity": lambda: traffic.user_activity(nexus).collect(),
        "table_statistics": lambda: catalog.table_statistics(tables).collect(),
        "table_row_counts": lambda: catalog.row_counts(tables).collect(),
        "correlated_requests": lambda: drain(correlate.correlated_requests(nginx, nexus)),
        "requests_reaching_repository": lambda: drain(correlate.requests_reaching_repository(nginx, nexus)),
        "requests_missing_in_repository": lambda: drain(correlate.requests_missing_in_repository(nginx, nexus)),
        "sql_method_distribution": lambda: adhoc.execute(
            spark, "SELECT method, COUNT(*) AS count FROM nginx_logs GROUP BY method ORDER BY count DESC"),
        "sql_union_all": lambda: adhoc.execute(
            spark, "SELECT 'nginx' AS source, COUNT(*) AS count FROM nginx_logs"
            " UNION ALL SELECT 'nexus' AS source, COUNT(*) AS count FROM nexus_logs"),
    }
    for key, run in runs.items():
        seconds[key] = timed(run)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "lines_per_second": rates, "sf": os.path.basename(SF_DIR), "cpus": int(CPUS),
    }))


if __name__ == "__main__":
    main()
