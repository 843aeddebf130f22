"""The registered queries and their SQL twins.

The given tables hold no access logs, so log lines are made from `events`, one per event (see
`weblens.plans.samples`), and every query starts from those lines: it parses them all.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from oracles import duckdb_sql, sql_texts
from weblens.formats import FORMATS
from weblens.functions import cell_text, human_size, repository_of, status_class, truncate_text
from weblens.operators import catalog, correlate, parse as p, quality, timeline, traffic
from weblens.plans import adhoc
from weblens.plans.ingest import LogStore
from weblens.plans.samples import packed, sample_files, sample_lines, write_files
from weblens.session import file_system, shared_folder
from weblens.sources import archives
from weblens.streaming import live
from weblens.streaming.incremental import ingest_new_files

# The subpackage may be left out, whatever is left of its folders; an error inside it is an error.
if all(find_spec(name) for name in ("corpus_pipeline", "weblens.llm")) and find_spec("weblens.llm.queries"):
    from weblens.llm import queries as llm_queries
else:
    llm_queries = None

Query = Callable[[SparkSession, str], DataFrame]

START = dt.datetime.fromisoformat(duckdb_sql.START)
END = dt.datetime.fromisoformat(duckdb_sql.END)
NOW = dt.datetime.fromisoformat(duckdb_sql.NOW)


def _parsed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lines = sample_lines(spark, sf_dir, name).withColumnRenamed("event_id", "id")
    return p.parse(lines, FORMATS[name], "line")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return p.accepted(_parsed(spark, sf_dir, name))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {f"{name}_logs": _table(spark, sf_dir, name) for name in ("nginx", "nexus")}


def _over(name: str, operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """A query over one good table."""
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, name), *args, **kwargs)


def _over_tables(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """A query over both good tables by name."""
    return lambda spark, sf_dir: operator(_tables(spark, sf_dir), *args, **kwargs)


def _over_pair(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """A query over the nginx and the Nexus table."""
    return lambda spark, sf_dir: operator(*_tables(spark, sf_dir).values(), *args, **kwargs)


def _quarantined(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return p.quarantine(_parsed(spark, sf_dir, name), FORMATS[name]).drop("ingested_at")
    return run


def _request_class(logs: DataFrame) -> DataFrame:
    return logs.groupBy("method", "http_version").agg(
        F.count("*").alias("requests"), F.count_distinct("path").alias("paths")
    )


def _timestamp_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the format makes of stamps of many shapes, each in a line of its own."""
    stamps = sample_lines(spark, sf_dir, "stamps")
    line = F.concat(F.lit("10.0.0.1 - - ["), "stamp", F.lit('] "GET / HTTP/1.1" 200 1 1 1 "-" [qtp]'))
    return p.parse(stamps.withColumn("line", line), FORMATS["nexus"], "line").select("event_id", "stamp", "timestamp")


def _created_daily(logs: DataFrame) -> DataFrame:
    """A sample by creation time, with the day of the request in its place."""
    day = F.date_trunc("day", "timestamp").cast("timestamp_ntz")
    return catalog.table_sample({"nginx_logs": logs.withColumn("created_at", day)},
                                "nginx_logs", by="created_at")


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reject_reasons(_parsed(spark, sf_dir, "nginx"))


def _both_parsed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: _parsed(spark, sf_dir, name) for name in ("nginx", "nexus")}


def _stats_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (quality.stats_by_file(f) for f in _both_parsed(spark, sf_dir).values())
    return first.unionByName(second)


def _stats_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.stats_by_format(_both_parsed(spark, sf_dir))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.processing_summary(_stats_total(spark, sf_dir), seconds=2.0)


def _as_of_clients(nginx: DataFrame, nexus: DataFrame) -> DataFrame:
    found = timeline.requests_as_of(nginx, nexus, within=3600, keys=["ip_address"])
    return found.select("id", "repository_id")


def _in_flight(operator: Callable[..., DataFrame]) -> Query:
    return _over("nexus", lambda logs: operator(logs, repository_of(F.col("path")), "repository"))


def _display(logs: DataFrame) -> DataFrame:
    return logs.select(
        "id",
        status_class(F.col("status_code")).alias("status_class"),
        human_size(F.col("response_size")).alias("size"),
        truncate_text(F.col("path"), 50).alias("path"),
        truncate_text(F.col("user_agent"), 30).alias("user_agent"),
        cell_text(F.col("response_size")).alias("size_cell"),
        cell_text(F.col("referer")).alias("referer_cell"),
    )


# --- storing ---------------------------------------------------------------------------------

def _raw(lines: DataFrame) -> DataFrame:
    """Sample lines in the shape the readers give."""
    return lines.select(
        F.col("line").alias("value"), "file_source", F.col("file_source").alias("file_path"),
        F.lit(None).cast("string").alias("problem"),
    )


def _content(store: LogStore, name: str) -> DataFrame:
    """A stored table without what differs from run to run."""
    return store.table(name).drop("id", "file_source", "created_at", "log_date")


def _filled(
    spark: SparkSession, sf_dir: str, name: str = "nginx", times: int = 1, fresh: bool = False
) -> LogStore:
    store = LogStore(spark, shared_folder(spark, "store"))
    for _ in range(times):
        store.write(_raw(sample_lines(spark, sf_dir, name)), FORMATS[name], fresh=fresh)
    return store


def _ingest_lines(name: str, times: int = 1, fresh: bool = False) -> Query:
    return lambda spark, sf_dir: _content(_filled(spark, sf_dir, name, times, fresh), name)


def _ingest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ingests: rows, different ids, and whether the second's ids are above the first's."""
    store = LogStore(spark, shared_folder(spark, "store"))
    lines = _raw(sample_lines(spark, sf_dir, "nginx"))
    store.write(lines, FORMATS["nginx"])
    first = store.table("nginx").agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
    store.write(lines, FORMATS["nginx"])
    return store.table("nginx").agg(
        F.count("*").alias("entries"), F.count_distinct("id").alias("ids"),
        (F.count_if(F.col("id") > first["last"]) == first["n"]).alias("ascending"),
        F.count("created_at").alias("stamped"))


def _log_folder(spark: SparkSession, sf_dir: str, compression: str) -> str:
    folder = shared_folder(spark, "logs")
    lines = sample_lines(spark, sf_dir, "nginx").select("line")
    lines.write.option("compression", compression).text(folder)
    return folder


def _ingest_folder(compression: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = LogStore(spark, shared_folder(spark, "store"))
        store.ingest(_log_folder(spark, sf_dir, compression), "nginx", globs=["part-*"])
        return _content(store, "nginx")
    return run


def _ingest_stream(compression: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = LogStore(spark, shared_folder(spark, "store"))
        folder = _log_folder(spark, sf_dir, compression)
        checkpoint = shared_folder(spark, "stream")
        ingest_new_files(store, folder, "nginx", checkpoint, globs=["part-*"]).awaitTermination()
        return _content(store, "nginx")
    return run


# A line of each log from long after all others: with it, all that came before is final.
_CLOSING = {
    "nginx": '0.0.0.0 - - [01/Jan/2100:00:00:00 +0000] "GET /closing HTTP/1.1" 200 1 "-" "-"',
    "nexus": '0.0.0.0 - - [01/Jan/2100:00:00:00 +0000] "GET /closing HTTP/1.1" 200 1 1 1 "-" [qtp]',
}


def _streamed(spark: SparkSession, sf_dir: str, run: Callable[..., object], *names: str) -> None:
    """Run a stream over folders of sample lines, stop, add the closing line to each, run again."""
    folders = {}
    for name in names:
        folders[name] = shared_folder(spark, "logs")
        sample_lines(spark, sf_dir, name).select("line").write.text(folders[name])
    run(folders).awaitTermination()
    for name in names:
        spark.createDataFrame([(_CLOSING[name],)], "line string").coalesce(1).write.mode("append").text(folders[name])
    run(folders).awaitTermination()


def _stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = live.WindowCounts(spark, shared_folder(spark, "windows"), FORMATS["nginx"], [(3600, 3600), (3600, 900)],
                               ["status_code"], delay=60 * 86400)
    checkpoint = shared_folder(spark, "stream")
    _streamed(spark, sf_dir, lambda folders: live.count_windows(counts, folders["nginx"], checkpoint, ["part-*"], files_per_batch=3), "nginx")
    return counts.counts(closed_only=True)


def _stateful(operator: Callable[..., DataFrame], *names: str) -> Query:
    """What a stateful operator has given out when its streams have ended."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out, checkpoint = shared_folder(spark, "streamed"), shared_folder(spark, "stream")

        def start(folders: dict[str, str]):
            streams = [p.accepted(live.parsed_stream(spark, folders[n], FORMATS[n], ["part-*"])).drop("file_source", "file_path") for n in names]
            start.schema = (made := operator(*streams)).schema
            return live.append_to(made, out, checkpoint)

        _streamed(spark, sf_dir, start, *names)
        return spark.read.schema(start.schema).parquet(out)
    return run


def _ingest_tar(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = packed(sample_lines(spark, sf_dir, "nginx"), "access.log")
    lines = archives.split_lines(archives.expand(files, "nginx", FORMATS["nginx"].globs, 3))
    parsed = p.parse(lines, FORMATS["nginx"])
    return p.accepted(parsed).drop("file_source", "file_path")


def _files(kind: str, globs: str | None = None, linked: bool = False) -> Callable[[SparkSession, str], LogStore]:
    """A store into which a folder of sample files has been read."""
    def run(spark: SparkSession, sf_dir: str) -> LogStore:
        folder = write_files(sample_files(sample_lines(spark, sf_dir, "nginx"), kind))
        path, system = file_system(spark, folder)
        if linked and system.getUri().getScheme() == "file":  # other file systems have no links
            below = Path(path.toUri().getPath())
            for name in sorted(x.name for x in below.iterdir()):
                (below / f"{name}.current").symlink_to(below / name)
        store = LogStore(spark, shared_folder(spark, "store"))
        store.ingest(folder, "nginx", globs=globs)
        return store
    return run


def _ingest_files(kind: str, globs: str | None = None, linked: bool = False) -> Query:
    """The good lines of sample files and where each comes from."""
    fill = _files(kind, globs, linked)
    return lambda spark, sf_dir: fill(spark, sf_dir).table("nginx").drop("id", "created_at", "log_date")


def _skipped_files(kind: str) -> Query:
    """What was skipped in sample files, with the kind of reason."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        refused = _files(kind)(spark, sf_dir).quarantine("nginx").where("raw_line IS NULL")
        return refused.select("file_source", F.substring_index("reason", ":", 1).alias("reason"))
    return run


def _stored_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).quarantine("nginx").select("format", "raw_line", "reason")


def _stored_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of three ingests, without what differs from run to run."""
    return _filled(spark, sf_dir, times=3).preview("nginx").drop("id", "created_at", "file_source")


def _quick_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics from summaries, and whether the estimate of clients is within 5 % of their number."""
    store = _filled(spark, sf_dir, times=2)
    exact = catalog.table_statistics({"nginx_logs": store.table("nginx")}).select("unique_ips").scalar()
    return store.quick_statistics("nginx").select(
        "table_name", "total_entries", "unique_days", "earliest_log", "latest_log",
        (F.abs(F.col("unique_ips") - exact) <= 0.05 * exact).alias("ips_close"))


def _ingest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, times=2).ingest_history("nginx")


def _stored_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = traffic.between(_filled(spark, sf_dir).table("nginx"), START, END)
    return logs.select("timestamp", "method", "path", "status_code", "ip_address", "user_agent")


# --- SQL -------------------------------------------------------------------------------------

def _views(spark: SparkSession, sf_dir: str) -> None:
    for name, logs in _tables(spark, sf_dir).items():
        logs.createOrReplaceTempView(name)


def _sql(key: str) -> Query:
    text, values = sql_texts.TEXTS[key]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _views(spark, sf_dir)
        return adhoc.query(spark, text, values)
    return run


def _sql_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return adhoc.run_sql(spark, sql_texts.CAPPED, limit=5000)


_NGINX, _NEXUS = FORMATS["nginx"], FORMATS["nexus"]

_QUERIES: dict[str, Query] = {
    "nginx_parse": lambda spark, sf_dir: _table(spark, sf_dir, "nginx"),
    "nexus_parse": lambda spark, sf_dir: _table(spark, sf_dir, "nexus"),
    "custom_service_parse": lambda spark, sf_dir: _table(spark, sf_dir, "custom_service"),
    "nginx_request_class": _over("nginx", _request_class),
    "nexus_timestamp_shapes": _timestamp_shapes,
    "nginx_quarantine": _quarantined("nginx"),
    "nexus_quarantine": _quarantined("nexus"),
    "custom_service_quarantine": _quarantined("custom_service"),
    "ingest_lines": _ingest_lines("nginx"),
    "ingest_append": _ingest_lines("nginx", times=2),
    "ingest_custom_service": _ingest_lines("custom_service"),
    "ingest_text_folder": _ingest_folder("none"),
    "ingest_gzip_folder": _ingest_folder("gzip"),
    "ingest_tar_archives": _ingest_tar,
    "ingest_zip_archives": _ingest_files("zip"),
    "ingest_nested_archives": _ingest_files("nested"),
    "ingest_damaged_archives": _ingest_files("damaged"),
    "damaged_archives_skipped": _skipped_files("damaged"),
    "ingest_tar_links": _ingest_files("links"),
    "tar_members_skipped": _skipped_files("links"),
    "ingest_linked_files": _ingest_files("mixed", "access.log*, other*.LOG", linked=True),
    "ingest_mixed_case": _ingest_files("mixed", "access.log*, other*.LOG"),
    "ingest_hidden_folders": _ingest_files("hidden"),
    "ingest_broken_bytes": _ingest_files("broken"),
    "ingest_stream": _ingest_stream("none"),
    "ingest_stream_gzip": _ingest_stream("gzip"),
    "ingest_nexus": _ingest_lines("nexus"),
    "ingest_fresh": _ingest_lines("nginx", times=2, fresh=True),
    "ingest_ids": _ingest_ids,
    "stored_preview": _stored_preview,
    "store_quick_statistics": _quick_statistics,
    "store_ingest_history": _ingest_history,
    "stored_quarantine": _stored_quarantine,
    "stored_time_range": _stored_time_range,
    "ingest_stats_by_file": _stats_by_file,
    "ingest_stats_total": _stats_total,
    "ingest_summary": _summary,
    "reject_reasons": _reasons,
    "nginx_preview": _over("nginx", catalog.preview, _NGINX.schema),
    "nexus_preview": _over("nexus", catalog.preview, _NEXUS.schema),
    "table_sample_by_id": _over_tables(catalog.table_sample, "nexus_logs"),
    "table_sample_by_created_at": _over("nginx", _created_daily),
    "nginx_top_paths": _over("nginx", traffic.top_paths),
    "nginx_status_distribution": _over("nginx", traffic.status_distribution),
    "nginx_method_distribution": _over("nginx", traffic.method_distribution),
    "nginx_traffic_cube": _over("nginx", traffic.traffic_cube),
    "nginx_traffic_sets": _over("nginx", traffic.traffic_cube, [["method", "status_class"], ["day"], []]),
    "nginx_top_clients": _over("nginx", traffic.top_clients),
    "nginx_hits_by_method_and_path": _over("nginx", traffic.hits_by_method_and_path),
    "nginx_size_by_method_and_status": _over("nginx", traffic.size_by_method_and_status),
    "nginx_size_range_by_status": _over("nginx", traffic.size_range_by_status),
    "nginx_time_range": _over("nginx", traffic.nginx_time_range, START, END),
    "nexus_time_range": _over("nexus", traffic.nexus_time_range, START, END),
    "nginx_recent_errors": _over("nginx", traffic.recent_errors, NOW),
    "nexus_top_repositories": _over("nexus", traffic.top_repositories),
    "nexus_user_activity": _over("nexus", traffic.user_activity),
    "nexus_action_distribution": _over("nexus", traffic.action_distribution),
    "custom_service_failures": _over("custom_service", traffic.failures_by_action),
    "table_statistics": _over_tables(catalog.table_statistics),
    "table_row_counts": _over_tables(catalog.row_counts),
    "table_profile": _over_tables(lambda tables: catalog.table_profile(
        {name: _declared_order(name, logs) for name, logs in tables.items()})),
    "all_logs": _over_tables(correlate.all_logs),
    "counts_by_source": _over_tables(lambda tables: correlate.counts_by_source(
        {name.removesuffix("_logs"): logs for name, logs in tables.items()})),
    "counts_side_by_side": _over_pair(correlate.counts_side_by_side),
    "correlated_requests": _over_pair(correlate.correlated_requests),
    "requests_reaching_repository": _over_pair(correlate.requests_reaching_repository),
    "requests_missing_in_repository": _over_pair(correlate.requests_missing_in_repository),
    "requests_as_of_repository": _over_pair(timeline.requests_as_of),
    "requests_as_of_clients": _over_pair(_as_of_clients),
    "request_pairs": _over_pair(timeline.request_pairs),
    "request_pairs_within_an_hour": _over_pair(timeline.request_pairs, seconds=3600),
    "repository_requests_in_flight": _in_flight(timeline.requests_in_flight),
    "repository_peak_in_flight": _in_flight(timeline.peak_in_flight),
    "client_sessions": _over("nginx", timeline.client_sessions),
    "stream_window_counts": _stream_window_counts,
    "stream_client_sessions": _stateful(live.session_stream, "nginx"),
    "stream_requests_missing": _stateful(live.missing_stream, "nginx", "nexus"),
    "display_requests": _over("nginx", _display),
    **{key: _sql(key) for key in sql_texts.TEXTS},
    "sql_row_cap": _sql_capped,
}


def _declared_order(name: str, logs: DataFrame) -> DataFrame:
    declared = [c for f in FORMATS.values() if f.table_name == name for c in f.schema.names]
    known = [c for c in declared if c in logs.columns]
    return logs.select(*known, *(c for c in logs.columns if c not in known))


def entry(spark: SparkSession) -> DataFrame:
    """Status distribution of parsed proxy lines."""
    return traffic.status_distribution(_table(spark, "/root/testdata/sf0.001", "nginx"))


def queries() -> dict[str, Query]:
    return {**_QUERIES, **(llm_queries.QUERIES if llm_queries else {})}


def oracle_sql() -> dict[str, str]:
    return {**duckdb_sql.QUERIES, **sql_texts.QUERIES, **(llm_queries.ORACLES if llm_queries else {})}
