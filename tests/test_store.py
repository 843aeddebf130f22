"""Storing, appending, retrying, statistics, previews and the streaming ingest."""

from __future__ import annotations

import contextlib
import datetime as dt
import gzip
import io
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from weblens import schemas
from weblens.formats import NEXUS, NGINX
from weblens.operators import catalog, parse as p, quality
from weblens.plans.ingest import LogStore
from weblens.sources.discover import list_plain, read_plain
from weblens.streaming.incremental import ingest_new_files

GOOD = '10.0.0.{n} - - [{day:02d}/May/2025:10:00:{n:02d} +0000] "GET /p{n} HTTP/1.1" {status} 1 "-" "a"'


def good(n, day=1, status=200):
    return GOOD.format(n=n, day=day, status=status)


def plan_of(frame, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain(mode)
    return out.getvalue()


def raw(spark, *lines, source="nginx:access.log"):
    rows = [(line, source, source, None) for line in lines]
    return spark.createDataFrame(rows, schemas.RAW_LINES).coalesce(1)


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "store"))


def test_ingest_of_a_folder(spark, store, tmp_path):
    logs = tmp_path / "logs"
    (logs / "a").mkdir(parents=True)
    (logs / "b").mkdir()
    (logs / "a" / "access.log").write_text("\n".join([good(1), "bad", good(2), "", "worse", good(3)]))
    (logs / "b" / "access.log").write_text(good(4, day=2) + "\n")
    (logs / "access.log.1.gz").write_bytes(gzip.compress((good(5) + "\nbroken").encode()))
    (logs / "access.log.tar").write_bytes(b"corrupt")
    report = store.ingest(str(logs), "nginx")
    assert (report.lines, report.entries, report.parse_errors, report.skipped) == (8, 5, 3, 1)
    assert report.success_rate == 5 / 8 and report.lines_per_second > 0

    table = store.table("nginx")
    assert table.columns == [*schemas.NGINX_LOGS.names, "auth_user", "tz_offset", "log_date"]
    assert [f.dataType for f in table.schema.fields[:14]] == [f.dataType for f in schemas.NGINX_LOGS]
    rows = table.collect()
    assert len({r.id for r in rows}) == 5
    for field in schemas.NGINX_LOGS.fields:
        if not field.nullable:
            assert all(r[field.name] is not None for r in rows)
    assert {r.created_at for r in rows} != {None}

    rejected = {(r.file_source, r.raw_line, r.reason.split(":")[0]) for r in store.quarantine("nginx").collect()}
    assert rejected == {
        ("nginx:access.log", "bad", "Invalid nginx log format"),
        ("nginx:access.log", "worse", "Invalid nginx log format"),
        ("nginx:access.log.1.gz->access.log.1", "broken", "Invalid nginx log format"),
        ("nginx:access.log.tar", None, "Unreadable archive"),
    }
    stats = {(r.file_path.rsplit("/", 2)[-2], r.file_source): tuple(r)[2:] for r in
             store.file_statistics("nginx").collect()}
    assert stats == {  # two folders, one file name: kept apart
        ("a", "nginx:access.log"): (3, 2, 5, 0.6),
        ("b", "nginx:access.log"): (1, 0, 1, 1.0),
        ("logs", "nginx:access.log.1.gz->access.log.1"): (1, 1, 2, 0.5),
    }


def test_append_continues_ids_and_fresh_starts_over(spark, store):
    first = store.write(raw(spark, good(1), good(2)), NGINX)
    second = store.write(raw(spark, good(3), "bad"), NGINX)
    assert (first.ingest, second.ingest) == (0, 1)
    ids = [r.id for r in store.table("nginx").orderBy("ip_address").collect()]
    assert ids == sorted(ids) and len(set(ids)) == 3
    assert [r.path for r in store.preview("nginx", 2).collect()] == ["/p3", "/p2"]
    store.write(raw(spark, good(9)), NGINX, fresh=True)
    assert [r.path for r in store.table("nginx").collect()] == ["/p9"]
    assert store.quarantine("nginx").count() == 0


def test_a_retried_batch_is_stored_once(spark, store):
    store.write(raw(spark, good(1)), NGINX, ingest=0)
    store.write(raw(spark, good(2), "bad"), NGINX, ingest=1)
    store.write(raw(spark, good(2), "bad"), NGINX, ingest=1)
    assert sorted(r.path for r in store.table("nginx").collect()) == ["/p1", "/p2"]
    assert store.quarantine("nginx").count() == 1
    store.write(raw(spark, good(3)), NGINX, origin="other", ingest=0)  # replaces nobody's rows
    store.write(raw(spark, good(4)), NGINX)
    store.write(raw(spark, good(3)), NGINX, origin="other", ingest=0)
    assert sorted(r.path for r in store.table("nginx").collect()) == ["/p1", "/p2", "/p3", "/p4"]
    assert store.preview("nginx", 1).first().path == "/p3"
    assert len({r.id for r in store.table("nginx").collect()}) == 4


def test_empty_input(spark, store, tmp_path):
    report = store.ingest(str(tmp_path / "nowhere"), "nginx", fresh=True)
    assert (report.lines, report.entries, report.success_rate) == (0, 0, 1.0)
    assert store.table("nginx").count() == 0
    assert store.preview("nginx").collect() == []
    stats = {r.table_name: r for r in catalog.table_statistics(store.tables()).collect()}
    assert stats["nginx_logs"].total_entries == 0 and stats["nginx_logs"].earliest_log is None
    counts = {r.table_name: r.row_count for r in catalog.row_counts(store.tables()).collect()}
    assert counts == {"nginx_logs": 0, "nexus_logs": 0, "total": 0}
    rows = {r.format: (r.files, r.lines, r.entries, r.success_rate) for r in store.statistics().collect()}
    assert rows == {name: (0, 0, 0, 1.0) for name in ("nginx", "nexus", None)}


def test_rebalanced_write_keeps_all_rows(spark, store):
    lines = [good(n % 60, day=1 + n % 3) for n in range(300)]
    report = store.write(raw(spark, *lines, "bad"), NGINX, rebalance=True)
    assert (report.entries, report.parse_errors) == (300, 1)
    assert store.table("nginx").count() == 300


def test_time_range_prunes_days_and_includes_both_ends(spark, store):
    store.write(raw(spark, *(good(n, day=n) for n in range(1, 10))), NGINX)
    start, end = dt.datetime(2025, 5, 3, 10, 0, 3), dt.datetime(2025, 5, 5, 10, 0, 5)
    found = store.time_range("nginx", start, end)
    assert [r.path for r in found.collect()] == ["/p5", "/p4", "/p3"]
    plan = plan_of(found)
    assert "log_date" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert [r.path for r in store.time_range("nginx", start, end, limit=1).collect()] == ["/p5"]


def test_preview_reads_full_rows_only_where_needed(spark, store):
    store.write(raw(spark, *(good(n) for n in range(1, 30))), NGINX)
    preview = store.preview("nginx", 3)
    assert [r.path for r in preview.collect()] == ["/p29", "/p28", "/p27"]
    assert "raw_log" not in preview.columns and preview.first().timestamp == "2025-05-01T10:00:29"
    plan = plan_of(preview)
    assert "ReadSchema: struct<id:bigint>" in plan  # the first pass
    sample = catalog.describe_sample(store.tables(), "nginx_logs", 5, stored=True)
    assert (sample["sample_size"], sample["total_rows"]) == (5, 29)
    assert [r["path"] for r in sample["sample_data"]] == ["/p29", "/p28", "/p27", "/p26", "/p25"]
    with pytest.raises(ValueError):
        catalog.table_sample(store.tables(), "secrets")


def test_views(spark, store):
    store.write(raw(spark, good(1), "bad"), NGINX)
    store.register_views()
    assert spark.sql("SELECT count(*) FROM nginx_logs").first()[0] == 1
    assert spark.sql("SELECT count(*) FROM nexus_logs").first()[0] == 0
    assert spark.sql("SELECT log_type, count(*) FROM all_logs GROUP BY 1").collect() == [("nginx_logs", 1)]
    assert spark.sql("SELECT format, raw_line FROM log_quarantine").collect() == [("nginx", "bad")]


def test_statistics_add_up(spark, store):
    store.write(raw(spark, good(1), "x", source="nginx:a").unionByName(
        raw(spark, good(2), source="nginx:b")), NGINX)
    nexus = '1.1.1.1 - u [01/May/2025:10:00:00 +0000] "GET /repository/m/x HTTP/1.1" 200 1 2 3 '
    store.write(raw(spark, nexus, "y", "z", source="nexus:c"), NEXUS)
    stats = {r.format: (r.files, r.lines, r.entries, r.parse_errors) for r in store.statistics().collect()}
    assert stats == {"nginx": (2, 3, 2, 1), "nexus": (1, 3, 1, 2), None: (3, 6, 3, 3)}
    summary = quality.processing_summary(store.statistics(), 2.0).where("format IS NULL").first()
    assert (summary.lines_per_second, summary.entries_per_second) == (3.0, 1.5)
    reasons = quality.reject_reasons(p.parse(raw(spark, "a", "b", good(1)), NGINX)).collect()
    assert [tuple(r) for r in reasons] == [("rejected", "Invalid nginx log format", 2)]


def test_profile(spark, store):
    store.write(raw(spark, good(1), good(2)), NGINX)
    rows = [r for r in catalog.table_profile(store.tables()).collect() if r.table_name == "nginx_logs"]
    by_name = {r.column_name: r for r in rows}
    assert [r.column_name for r in sorted(rows, key=lambda r: r.position)][:3] == ["id", "ip_address", "remote_user"]
    assert by_name["id"].primary_key and by_name["id"].not_null
    assert by_name["status_code"].data_type == "int" and by_name["status_code"].not_null
    assert not by_name["referer"].not_null and by_name["referer"].row_count == 2


def test_streaming_ingest_takes_each_file_once(spark, store, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    checkpoint = str(tmp_path / "checkpoint")
    (logs / "access.log").write_text(good(1) + "\nbad\n")
    (logs / "error.log").write_text(good(2))
    store.write(raw(spark, good(1, day=1)), NGINX)  # a batch ingest of the same day stays
    ingest_new_files(store, str(logs), "nginx", checkpoint).awaitTermination()
    (logs / "access.log.1").write_text(good(3) + "\n")
    ingest_new_files(store, str(logs), "nginx", checkpoint).awaitTermination()
    ingest_new_files(store, str(logs), "nginx", checkpoint).awaitTermination()
    assert sorted(r.path for r in store.table("nginx").collect()) == ["/p1", "/p1", "/p3"]
    assert store.quarantine("nginx").count() == 1
    ids = [r.id for r in store.table("nginx").orderBy(F.col("path")).collect()]
    assert len(set(ids)) == 3


def test_streaming_ingest_reads_archives(spark, store, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    checkpoint = str(tmp_path / "checkpoint")
    (logs / "access.log").write_text(good(1) + "\n")
    (logs / "access.log.1.gz").write_bytes(gzip.compress((good(2) + "\nbad").encode()))
    ingest_new_files(store, str(logs), "nginx", checkpoint).awaitTermination()
    (logs / "access.log.2.gz").write_bytes(gzip.compress(good(3).encode()))
    (logs / "access.log.3.gz").write_bytes(b"corrupt")
    ingest_new_files(store, str(logs), "nginx", checkpoint).awaitTermination()
    assert sorted(r.path for r in store.table("nginx").collect()) == ["/p1", "/p2", "/p3"]
    assert sorted(r.reason.split(":")[0] for r in store.quarantine("nginx").collect()) == [
        "Invalid nginx log format", "Unreadable archive"]


def test_writers_of_two_origins_at_once(spark, store):
    lines = {name: raw(spark, *(good(n, day=1 + n % 5) for n in range(50))) for name in ("a", "b", "c")}
    with ThreadPoolExecutor(3) as pool:
        tasks = [pool.submit(store.write, frame, NGINX, origin=name) for name, frame in lines.items()]
        assert [t.result().entries for t in tasks] == [50, 50, 50]
    assert store.table("nginx").count() == 150
    with pytest.raises(ValueError):
        store.write(raw(spark, good(1)), NGINX, origin="../b")


def test_a_retry_with_fewer_days_leaves_nothing_stale(spark, store):
    store.write(raw(spark, good(1, day=1)), NGINX)
    store.write(raw(spark, good(2, day=2), good(3, day=3), "bad"), NGINX, ingest=1)
    store.write(raw(spark, good(2, day=2)), NGINX, ingest=1)
    assert sorted(r.path for r in store.table("nginx").collect()) == ["/p1", "/p2"]
    assert store.quarantine("nginx").count() == 0
    report = store.write(raw(spark, good(4)), NGINX)
    assert (report.ingest, report.entries) == (2, 1)


def test_a_failed_fresh_start_keeps_the_table(spark, store):
    store.write(raw(spark, good(1)), NGINX)
    broken = raw(spark, good(2)).withColumn("value", F.raise_error(F.lit("no source")).cast("string"))
    with pytest.raises(Exception, match="no source"):
        store.write(broken, NGINX, fresh=True)
    assert [r.path for r in store.table("nginx").collect()] == ["/p1"]
    store.write(raw(spark, good(3)), NGINX)  # takes the next number


def test_inserting_parsed_rows(spark, store):
    columns = "ip_address string, timestamp timestamp_ntz, path string, response_size int"
    when = dt.datetime(2025, 1, 15, 10)
    rows = [("1.1.1.1", when, "/a", 7), ("1.1.1.2", when, "/b", None)]
    assert store.insert(spark.createDataFrame(rows, columns), "nginx") == 2
    assert store.insert(spark.createDataFrame([], columns), "nginx") == 0
    found = store.table("nginx").orderBy("path").collect()
    assert [(r.path, r.response_size, r.method, r.status_code, r.referer) for r in found] == [
        ("/a", 7, "", 0, None), ("/b", None, "", 0, None)]
    broken = [("1.1.1.3", when, "/c", 1), ("1.1.1.4", None, "/d", 1)]
    with pytest.raises(Exception, match="timestamp must not be NULL"):
        store.insert(spark.createDataFrame(broken, columns), "nginx")
    assert store.table("nginx").count() == 2
    with pytest.raises(ValueError):
        store.insert(spark.createDataFrame([("/x",)], "path string"), "nginx")


def test_times_do_not_depend_on_the_session_zone(spark, store):
    text = good(1).replace("01/May/2025:10:00:01", "09/Mar/2025:02:30:00")  # skipped in New York
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        store.write(raw(spark, text), NGINX)
        assert store.preview("nginx").first().timestamp == "2025-03-09T02:30:00"
        at = dt.datetime(2025, 3, 9, 2, 30)
        assert store.time_range("nginx", at, at).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_files_without_lines_count_when_listed(spark, store, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "access.log").write_text(good(1) + "\nbad\n")
    (logs / "access.log.1").write_text("\n  \n")
    (logs / "access.log.2").write_text("")  # no bytes at all: Spark lists no such file
    (logs / "error.log").write_text("x")
    store.ingest(str(logs), "nginx")
    assert store.file_statistics("nginx").count() == 1
    files = list_plain(spark, str(logs), NGINX)
    stats = {r.file_source: tuple(r)[2:] for r in store.file_statistics("nginx", files).collect()}
    assert stats == {"nginx:access.log": (1, 1, 2, 0.5), "nginx:access.log.1": (0, 0, 0, 1.0)}
    parsed = p.parse(read_plain(spark, str(logs), NGINX), NGINX)
    total = quality.stats_by_format({"nginx": parsed}, {"nginx": files}).where("format IS NULL").first()
    assert (total.files, total.lines) == (2, 2)


def test_ingest_of_several_formats(spark, store, tmp_path):
    for name, text in (("access.log", good(1) + "\nbad"), ("request.log", "worse")):
        (tmp_path / name).write_text(text)
    reports = store.ingest_all({"nginx": str(tmp_path), "nexus": str(tmp_path)}, fresh=True)
    assert {n: (r.lines, r.entries, r.parse_errors) for n, r in reports.items()} == {
        "nginx": (2, 1, 1), "nexus": (1, 0, 1), "total": (3, 1, 2)}
    assert reports["total"].success_rate == 1 / 3


def _paths(store):
    return sorted(r.path for r in store.table("nginx").collect())


def test_readers_see_the_old_rows_or_the_new_ones(spark, store, monkeypatch):
    """A driver that dies anywhere in a fresh start leaves one generation; the next start clears up."""
    store.write(raw(spark, good(1)), NGINX)
    store.write(raw(spark, good(2)), NGINX, origin="other")
    seen = []
    finish = LogStore._finish

    def dies_before(self, *args):
        seen.append(_paths(self))
        raise RuntimeError("the driver dies")

    monkeypatch.setattr(LogStore, "_finish", dies_before)
    with pytest.raises(RuntimeError):
        store.write(raw(spark, good(3)), NGINX, fresh=True)
    assert seen == [["/p1", "/p2"]] and _paths(store) == ["/p1", "/p2"]

    monkeypatch.setattr(LogStore, "_finish", finish)
    monkeypatch.setattr("weblens.plans.ingest.remove_folder", lambda *args: (_ for _ in ()).throw(RuntimeError("dies while removing")))
    with pytest.raises(RuntimeError):
        store.write(raw(spark, good(4)), NGINX, fresh=True)
    assert _paths(store) == ["/p4"]
    assert [r.id for r in store.table("nginx").collect()] == [0]
    monkeypatch.undo()

    store.write(raw(spark, good(5)), NGINX)
    store.write(raw(spark, good(6)), NGINX, origin="other")
    assert _paths(store) == ["/p4", "/p5", "/p6"]
    store.write(raw(spark, good(7)), NGINX, fresh=True)
    assert _paths(store) == ["/p7"] and sum(map(len, store._folders(NGINX).values())) == 1


def test_a_fresh_start_that_fails_to_write_changes_nothing(spark, store):
    store.write(raw(spark, good(1)), NGINX)
    broken = raw(spark, good(2)).withColumn("value", F.raise_error(F.lit("no such line")).cast("string"))
    with pytest.raises(Exception, match="no such line"):
        store.write(broken, NGINX, fresh=True)
    assert _paths(store) == ["/p1"]
    store.write(raw(spark, good(3)), NGINX)
    assert _paths(store) == ["/p1", "/p3"]


def test_previews_read_the_newest_ingests_only(spark, store):
    for n in range(1, 6):
        store.write(raw(spark, good(2 * n), good(2 * n + 1), "bad"), NGINX)
    store.write(raw(spark, good(50)), NGINX, origin="other")
    assert [r.path for r in store.preview("nginx", 3).collect()] == ["/p50", "/p11", "/p10"]
    assert [r.path for r in store.sample("nginx", 4).collect()] == ["/p50", "/p11", "/p10", "/p9"]
    assert store.preview("nginx", 100).count() == 11
    plan = store._newest(NGINX, 3)._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "ingest" in filters and "origin" in filters
    files = {r.f for r in store._newest(NGINX, 3).select(F.input_file_name().alias("f")).collect()}
    assert files and all("ingest=3" in f or "ingest=4" in f or "origin=other" in f for f in files)


def test_statistics_from_summaries(spark, store):
    lines = [good(n % 60, day=1 + n % 5).replace("10.0.0.", f"10.{n % 7}.0.") for n in range(900)]
    store.write(raw(spark, *lines[:400], "bad", "worse"), NGINX)
    store.write(raw(spark, *lines[400:]), NGINX, origin="other", ingest=7)
    store.write(raw(spark, *lines[:10]), NGINX, origin="other", ingest=8)
    exact = catalog.table_statistics({"nginx_logs": store.table("nginx")}).first()
    quick = store.quick_statistics("nginx").first()
    assert all(quick[c] == exact[c] for c in ("table_name", "total_entries", "unique_days", "earliest_log", "latest_log"))
    assert abs(quick.unique_ips - exact.unique_ips) <= 0.03 * exact.unique_ips
    history = {(r.origin, r.ingest): (r.entries, r.parse_errors, r.skipped) for r in store.ingest_history("nginx").collect()}
    assert history == {("batch", 0): (400, 2, 0), ("other", 7): (500, 0, 0), ("other", 8): (10, 0, 0)}
    plan = store.quick_statistics("nginx")._jdf.queryExecution().optimizedPlan().toString()
    assert "raw_log" not in plan and not any("/nginx_logs/origin" in f and "_summaries" not in f for f in store.quick_statistics("nginx").inputFiles())
    # A batch that is stored again is summed up again; a fresh start starts over.
    store.write(raw(spark, *lines[:30]), NGINX, origin="other", ingest=8)
    assert store.quick_statistics("nginx").first().total_entries == 930
    store.write(raw(spark, good(1)), NGINX, fresh=True)
    assert tuple(store.quick_statistics("nginx").first())[1:4] == (1, 1, 1)
    assert store.quick_statistics("nexus").first().total_entries == 0


def test_sketch_error(spark, store):
    """The estimate of many clients is within 5 %, three times the usual error."""
    lines = spark.range(30_000).selectExpr(
        "concat('10.', id % 200, '.', id DIV 200 % 200, '.1 - - [02/Jan/2024:00:00:00 +0000] \"GET / HTTP/1.1\" 200 1 \"-\" \"-\"') AS value",
        "'nginx:access.log' AS file_source", "'f' AS file_path", "CAST(NULL AS string) AS problem")
    store.write(lines, NGINX)
    assert abs(store.quick_statistics("nginx").first().unique_ips - 30_000) <= 1500


def test_cube_equals_grouped_counts(spark):
    from weblens.operators import traffic

    rows = [(m, s, dt.datetime(2024, 1, d), z) for m in ("GET", None) for s in (200, 404, 500) for d in (1, 2) for z in (1, 2, None)]
    logs = spark.createDataFrame(rows, "method string, status_code int, timestamp timestamp_ntz, response_size long")
    got = {(r.level, r.method, r.status_class, r.day): (r.requests, r.bytes) for r in traffic.traffic_cube(logs).collect()}
    names = {200: "success", 404: "client-error", 500: "server-error"}
    want = {}
    for level in range(8):
        for m, s, t, z in rows:
            key = (level, None if level & 4 else m, None if level & 2 else names[s], None if level & 1 else t.date())
            n, size = want.get(key, (0, 0))
            want[key] = n + 1, size + (z or 0)
    assert got == want
    assert len([r for r in traffic.traffic_cube(logs, [["day"], []]).collect()]) == 3
    assert [r.requests for r in traffic.traffic_cube(logs.limit(0)).collect()] in ([], [0], [None])
