"""Named queries, matching across logs (against brute force), presentation."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weblens.functions import cell_text, human_size, status_class, truncate_text
from weblens.operators import correlate, traffic

BASE = dt.datetime(2025, 1, 15, 10, 0)
LOGS = "id long, ip_address string, timestamp timestamp_ntz, method string, path string, tz_offset string"


def logs(spark, rows):
    return spark.createDataFrame(rows, LOGS)


def random_logs(seed, size, span):
    draw = random.Random(seed)
    return [(
        i, draw.choice(["a", "a", "a", "b"]), BASE + dt.timedelta(seconds=draw.randrange(-span, span)),
        draw.choice(["GET", "PUT"]), draw.choice(["/x", "/x", "/y"]), draw.choice([None, "+0000", "+0100", "-0030"]),
    ) for i in range(size)]


def utc(row):
    offset = row[5]
    if not offset:
        return row[2]
    sign = -1 if offset[0] == "-" else 1
    return row[2] - sign * dt.timedelta(hours=int(offset[1:3]), minutes=int(offset[3:]))


@pytest.mark.parametrize("seconds,normalise,span", [
    (0, False, 60), (1, False, 300), (5, False, 2000), (5, True, 4000), (400, False, 9000), (3600, True, 9000),
])
def test_matching_equals_brute_force(spark, seconds, normalise, span):
    nginx, nexus = random_logs(1, 300, span), random_logs(2, 200, span)
    at = utc if normalise else (lambda row: row[2])

    def near(a):
        return sum((a[1], a[3], a[4]) == (b[1], b[3], b[4])
                   and abs((at(a) - at(b)).total_seconds()) <= seconds for b in nexus)

    expected = {}
    for row in nginx:
        key = (row[1], row[3], row[4], at(row))
        expected[key] = (expected.get(key, (0, 0))[0] + 1, near(row))
    args = (logs(spark, nginx), logs(spark, nexus), seconds, normalise)
    found = {tuple(r)[:4]: tuple(r)[4:] for r in correlate.correlated_requests(*args).collect()}
    assert found == expected
    reaching = {r.id for r in correlate.requests_reaching_repository(*args).collect()}
    missing = [r.id for r in correlate.requests_missing_in_repository(*args).collect()]
    assert reaching == {row[0] for row in nginx if near(row)}
    assert sorted(missing) == sorted({row[0] for row in nginx} - reaching)


def test_matching_with_one_key_holding_most_rows(spark):
    """Two thirds of the rows share one key and second: counts stay whole, nothing is paired up."""
    hot = spark.range(200_000).select(
        "id", F.lit("a").alias("ip_address"),
        F.when(F.col("id") % 3 < 2, F.lit(BASE)).otherwise(
            F.timestamp_add("SECOND", F.col("id"), F.lit(BASE).cast("timestamp_ntz"))
        ).cast("timestamp_ntz").alias("timestamp"),
        F.lit("GET").alias("method"), F.lit("/health").alias("path"), F.lit(None).cast("string").alias("tz_offset"),
    )
    busiest = correlate.correlated_requests(hot, hot, 1).orderBy(F.desc("nginx_requests")).first()
    assert busiest.nginx_requests == 133_334
    assert busiest.nexus_requests == 133_334  # no other request within a second
    assert correlate.requests_missing_in_repository(hot, hot, 1).count() == 0
    assert correlate.requests_reaching_repository(hot, hot, 1).count() == 200_000


def test_negative_distance(spark):
    empty = logs(spark, [])
    with pytest.raises(ValueError):
        correlate.correlated_requests(empty, empty, -1)
    with pytest.raises(ValueError):
        correlate.requests_reaching_repository(empty, empty, -1)


TABLE = "id long, ip_address string, remote_user string, timestamp timestamp_ntz, method string, path string, status_code int, response_size long, user_agent string"


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (1, "a", "-", BASE, "GET", "/repository/maven/x", 200, 10, "m"),
        (2, "a", "bob", BASE + dt.timedelta(hours=1), "PUT", "/repository/maven/y", 201, None, "m"),
        (3, "b", "", BASE + dt.timedelta(days=1), "HEAD", "/repository/npm/x", 404, 30, "m"),
        (4, "b", "bob", BASE + dt.timedelta(days=2), "DELETE", "/service/ping", 500, 0, "m"),
        (5, "a", "eve", BASE + dt.timedelta(days=2), "GET", "/repository/", 200, 20, "m"),
        (6, "c", None, BASE, "OPTIONS", "/repository/maven/x", 200, 5, "m"),
    ]
    return spark.createDataFrame(rows, TABLE)


def values(frame):
    return [tuple(r) for r in frame.collect()]


def test_counts(table):
    assert values(traffic.top_paths(table, 2)) == [("/repository/maven/x", 2), ("/repository/", 1)]
    assert values(traffic.status_distribution(table)) == [(200, 3), (201, 1), (404, 1), (500, 1)]
    assert values(traffic.method_distribution(table))[0] == ("GET", 2)
    assert values(traffic.top_clients(table)) == [("a", 3), ("b", 2), ("c", 1)]
    assert values(traffic.top_repositories(table)) == [("maven", 3), ("npm", 1)]
    assert values(traffic.user_activity(table)) == [("bob", 2), ("eve", 1)]
    assert values(traffic.action_distribution(table)) == [
        ("download", 3), ("delete", 1), ("other", 1), ("upload", 1)]
    assert values(traffic.hits_by_method_and_path(table)) == [
        ("GET", "/repository/", 1), ("GET", "/repository/maven/x", 1), ("OPTIONS", "/repository/maven/x", 1)]
    assert values(traffic.size_by_method_and_status(table))[0] == ("GET", 200, 2, 15.0)
    assert values(traffic.size_range_by_status(table)) == [
        (200, 3, 5, 20), (201, 1, None, None), (404, 1, 30, 30), (500, 1, 0, 0)]


def test_time_ranges(table):
    found = traffic.nginx_time_range(table, BASE, BASE + dt.timedelta(days=1)).collect()
    assert [r.status_code for r in found] == [404, 201, 200, 200]
    found = traffic.nexus_time_range(table, BASE, BASE + dt.timedelta(hours=1), limit=1).collect()
    assert [(r.username, r.repository, r.action) for r in found] == [("bob", "maven", "upload")]
    now = BASE + dt.timedelta(days=2)
    assert [r.id for r in traffic.recent_errors(table, now).orderBy("id").collect()] == [3, 4]


def test_stacking_and_side_by_side(table):
    other = table.select("id", "path", F.lit("t").alias("thread_info"))
    stacked = correlate.all_logs({"nginx_logs": table, "nexus_logs": other})
    assert stacked.count() == 12 and "thread_info" in stacked.columns
    assert stacked.where("log_type = 'nexus_logs' AND method IS NULL").count() == 6
    assert values(correlate.counts_by_source({"nginx": table, "nexus": other})) == [("nginx", 6), ("nexus", 6)]
    assert values(correlate.counts_side_by_side(table, other)) == [(6, 6)]


@pytest.mark.parametrize("status,expected", [
    (200, "success"), (299, "success"), (302, "redirect"), (404, "client-error"), (500, "server-error"),
    (999, "server-error"), (100, "unknown"), (0, "unknown"), (None, "unknown"),
])
def test_status_class(spark, status, expected):
    assert spark.range(1).select(status_class(F.lit(status).cast("int"))).first()[0] == expected


@pytest.mark.parametrize("size,expected", [
    (None, "-"), (0, "-"), (1, "1B"), (1023, "1023B"), (1024, "1.0KB"), (1280, "1.3KB"), (1536, "1.5KB"),
    (1048575, "1024.0KB"), (1048576, "1.0MB"), (5 << 30, "5120.0MB"),
])
def test_human_size(spark, size, expected):
    assert spark.range(1).select(human_size(F.lit(size).cast("long"))).first()[0] == expected


def test_texts(spark):
    row = spark.range(1).select(
        truncate_text(F.lit("abcdef"), 3), truncate_text(F.lit("abc"), 3), truncate_text(F.lit(None).cast("string"), 3),
        cell_text(F.lit(None).cast("long")), cell_text(F.lit(1234)),
    ).first()
    assert tuple(row) == ("abc...", "abc", None, "", "1234")
