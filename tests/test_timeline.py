"""Operators along time against plain sequential versions, on logs with a hot key and crossings of stretches."""

from __future__ import annotations

import datetime as dt
import random
from bisect import bisect_right
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weblens.operators import timeline

START = dt.datetime(2024, 3, 9, 23, 40)
SCHEMA = "id long, ip_address string, method string, path string, timestamp timestamp_ntz, response_size long, processing_time_ms long"


def _rows(seed: int, count: int, span: int, hot: float = 0.4, micros: bool = False):
    """Rows over `span` seconds; a share `hot` of them has one key."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        key = 0 if rng.random() < hot else rng.randrange(1, 12)
        at = START + dt.timedelta(seconds=rng.randrange(span), microseconds=rng.randrange(10**6) if micros else 0)
        out.append((i, f"10.0.0.{key}", "GET", f"/{key}", at, rng.randrange(1000), rng.choice([None, 0, 700, 4000, 900_000])))
    return out + [(count, None, "GET", "/", START, 1, 5)]


@pytest.fixture(scope="module")
def logs(spark):
    def make(*args, **kwargs):
        return spark.createDataFrame(_rows(*args, **kwargs), SCHEMA)
    return make


def _by_key(frame):
    found = defaultdict(list)
    for r in frame.collect():
        if r.ip_address is not None:
            found[r.ip_address, r.method, r.path].append((r.timestamp, r.id))
    return {k: sorted(v) for k, v in found.items()}


@pytest.mark.parametrize("micros", [False, True])
def test_as_of_equals_a_search_in_each_history(logs, micros):
    nginx, nexus = logs(1, 600, 5000, micros=micros), logs(2, 300, 5000, micros=micros)
    histories = _by_key(nexus)
    for within in (None, 30):
        for r in timeline.requests_as_of(nginx, nexus, within).collect():
            history = histories.get((r.ip_address, r.method, r.path), [])
            at = bisect_right(history, (r.timestamp, 10**9))
            want = history[at - 1] if at else None
            if want and within is not None and r.timestamp - want[0] > dt.timedelta(seconds=within):
                want = None
            assert r.repository_id == (want and want[1]), r
            assert r.age_ms == (want and (r.timestamp - want[0]) // dt.timedelta(milliseconds=1))


def test_as_of_carries_over_a_long_silence(logs, spark):
    old = spark.createDataFrame([(7, "a", "GET", "/", START, 1, 1)], SCHEMA)
    late = spark.createDataFrame([(1, "a", "GET", "/", START + dt.timedelta(days=400), 1, 1), (2, "a", "GET", "/", START, 1, 1),
                                  (3, "a", "GET", "/", START - dt.timedelta(seconds=1), 1, 1)], SCHEMA)
    assert {r.id: r.repository_id for r in timeline.requests_as_of(late, old).collect()} == {1: 7, 2: 7, 3: None}
    assert timeline.requests_as_of(late, old.limit(0)).where("repository_id IS NULL").count() == 3
    assert timeline.requests_as_of(late.limit(0), old).count() == 0


def _matcher(proxy, repository, seconds):
    """The pairs of one key, one row at a time."""
    proxy = sorted((t.replace(microsecond=0), i) for t, i in proxy)
    repository = sorted((t.replace(microsecond=0), i) for t, i in repository)
    reach, pairs, p, r = dt.timedelta(seconds=seconds), [], 0, 0
    while p < len(proxy) and r < len(repository):
        if repository[r][0] < proxy[p][0] - reach:
            r += 1
        elif repository[r][0] > proxy[p][0] + reach:
            p += 1
        else:
            pairs.append((proxy[p][1], repository[r][1]))
            p, r = p + 1, r + 1
    return pairs


@pytest.mark.parametrize("seconds, span, proxies, repositories, hot", [
    (5, 4000, 800, 800, 0.4), (0, 900, 500, 700, 0.4), (60, 9000, 700, 500, 1.0), (30, 20_000, 2000, 1990, 1.0), (5, 30, 400, 380, 0.5)])
def test_pairing_equals_a_sequential_matcher(logs, seconds, span, proxies, repositories, hot):
    nginx, nexus = logs(3, proxies, span, hot), logs(4, repositories, span, hot)
    left, right = _by_key(nginx), _by_key(nexus)
    want = [p for key, rows in left.items() for p in _matcher(rows, right.get(key, []), seconds)]
    got = [tuple(r) for r in timeline.request_pairs(nginx, nexus, seconds).collect()]
    assert sorted(got) == sorted(want) and want


def test_pairing_where_every_queue_depends_on_the_last(spark):
    """Proxy requests come 20 s ahead of their partners all day long: no stretch begins with an empty queue."""
    times = [START + dt.timedelta(seconds=10 * i) for i in range(1000)]
    nginx = spark.createDataFrame([(i, "a", "GET", "/", t, 1, 1) for i, t in enumerate(times)], SCHEMA)
    nexus = spark.createDataFrame([(i, "a", "GET", "/", t + dt.timedelta(seconds=20), 1, 1) for i, t in enumerate(times)], SCHEMA)
    got = {r.id: r.repository_id for r in timeline.request_pairs(nginx, nexus, 25).collect()}
    assert got == dict(_matcher([(t, i) for i, t in enumerate(times)], [(t + dt.timedelta(seconds=20), i) for i, t in enumerate(times)], 25))


@pytest.mark.parametrize("seconds", [0, 5, 3600])
def test_pairing_reads_each_log_once_and_follows_only_what_is_in_reach(spark, monkeypatch, seconds):
    """Requests far from all others of their key are left out, those across a border of stretches are not."""
    stretch = max(timeline.STRETCH, 2 * seconds + 1)
    origin = dt.datetime(1970, 1, 1)
    border = origin + dt.timedelta(seconds=((START - origin) // dt.timedelta(seconds=stretch)) * stretch)
    near = [(0, "a", border, border), (1, "b", border, border + dt.timedelta(seconds=seconds)),
            (2, "c", border - dt.timedelta(seconds=1), border - dt.timedelta(seconds=1) + dt.timedelta(seconds=seconds)),
            (3, "d", border + dt.timedelta(seconds=seconds), border), (4, "e", border, border - dt.timedelta(seconds=seconds))]
    far = [(10 + i, f"x{i % 7}", START + dt.timedelta(days=2 * i)) for i in range(300)]
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def log(rows):
        frame = spark.createDataFrame([(i, key, "GET", "/", at, 1, 1) for i, key, at in rows], SCHEMA)
        return frame.mapInArrow(read, frame.schema)

    nginx = [(i, key, at) for i, key, at, _ in near] + far
    nexus = [(i, key, at) for i, key, _, at in near] + [(i, key, at + dt.timedelta(days=1)) for i, key, at in far]
    matched, followed = timeline._matched, []
    monkeypatch.setattr(timeline, "_matched", lambda work, *args: (followed.append(work.count()), matched(work, *args))[1])
    got = sorted(tuple(r) for r in timeline.request_pairs(log(nginx), log(nexus), seconds).collect())
    assert got == [(i, i) for i in range(5)]
    assert followed[0] <= 2 * len(near) and seen.value == len(nginx) + len(nexus)


def test_pairing_of_empty_logs(logs):
    nginx = logs(3, 10, 100)
    assert timeline.request_pairs(nginx, nginx.limit(0)).count() == 0
    assert timeline.request_pairs(nginx.limit(0), nginx.limit(0)).count() == 0


def test_requests_in_flight_equal_a_count_per_second(logs):
    frame = logs(5, 400, 8000, micros=True)
    want = defaultdict(int)
    for r in frame.collect():
        if r.processing_time_ms is None or r.ip_address is None:
            continue
        first = r.timestamp.replace(microsecond=0)
        last = (r.timestamp + dt.timedelta(milliseconds=r.processing_time_ms)).replace(microsecond=0)
        while first <= last:
            want[r.ip_address, first] += 1
            first += dt.timedelta(seconds=1)
    got = {(r.client, r.second): r.requests for r in timeline.requests_in_flight(frame, F.col("ip_address"), "client").collect()}
    assert got == want
    peaks = {r.client: (r.peak, r.first_reached) for r in timeline.peak_in_flight(frame, F.col("ip_address"), "client").collect()}
    for client in {c for c, _ in want}:
        most = max(n for (c, _), n in want.items() if c == client)
        assert peaks[client] == (most, min(s for (c, s), n in want.items() if c == client and n == most))


@pytest.mark.parametrize("gap", [7, 120, 1800])
def test_sessions_equal_a_walk_through_each_client(logs, gap):
    frame = logs(6, 700, 40_000, micros=True)
    want, by = {}, defaultdict(list)
    for r in frame.collect():
        if r.ip_address is not None:
            by[r.ip_address].append((r.timestamp, r.response_size))
    for client, rows in by.items():
        number, last = 0, None
        for at, size in sorted(rows):
            if last is None or at - last >= dt.timedelta(seconds=gap):
                number += 1
                want[client, number] = [at, at, 0, 0]
            session = want[client, number]
            session[1], session[2], session[3], last = at, session[2] + 1, session[3] + size, at
    got = {(r.ip_address, r.session): [r.first_request, r.last_request, r.requests, r.bytes]
           for r in timeline.client_sessions(frame, gap).collect()}
    assert got == want


def test_no_window_holds_a_whole_history(logs):
    """Every window over rows is partitioned by a stretch of time, apart from scans over stretches."""
    plan = timeline.client_sessions(logs(6, 10, 100))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_stretch" in line for line in windows)
