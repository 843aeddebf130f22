"""Streams against the batch: windows with late rows and restarts, sessions, requests that never arrive."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest

from weblens.formats import FORMATS
from weblens.operators import correlate, parse as p, timeline
from weblens.streaming import live

NGINX, NEXUS = FORMATS["nginx"], FORMATS["nexus"]
START = dt.datetime(2024, 3, 9, 23, 0)


def _nginx(client: int, second: int, path: str = "/a", status: int = 200) -> str:
    at = (START + dt.timedelta(seconds=second)).strftime("%d/%b/%Y:%H:%M:%S")
    return f'10.0.0.{client} - - [{at} +0000] "GET {path} HTTP/1.1" {status} 10 "-" "-"'


def _nexus(client: int, second: int, path: str = "/a") -> str:
    at = (START + dt.timedelta(seconds=second)).strftime("%d/%b/%Y:%H:%M:%S")
    return f'10.0.0.{client} - - [{at} +0000] "GET {path} HTTP/1.1" 200 10 1 5 "-" [qtp1-1]'


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "logs"
    made.mkdir()
    return made


def _put(folder, name: str, *lines: str) -> None:
    (folder / name).write_text("\n".join(lines) + "\n")


def _windows(seconds, length, step):
    out = Counter()
    for second, status in seconds:
        for k in range(length // step):
            out[status, length, step, START + dt.timedelta(seconds=(second // step - k) * step)] += 1
    return out


def test_windows_after_restarts_equal_the_batch_and_late_rows_are_kept(spark, folder, tmp_path):
    windows = [(60, 60), (120, 30)]

    def run():
        counts = live.WindowCounts(spark, str(tmp_path / "counts"), NGINX, windows, ["status_code"], delay=100)
        live.count_windows(counts, str(folder), str(tmp_path / "checkpoint"), files_per_batch=1).awaitTermination()
        return counts

    first = [(s, 200 if s % 3 else 404) for s in range(0, 600, 7)]
    _put(folder, "access.log.1", *(_nginx(1, s, status=c) for s, c in first), "not a log line")
    run()
    second = [(s, 200) for s in range(500, 900, 11)]  # reaches back behind what was seen, not behind the watermark
    _put(folder, "access.log.2", *(_nginx(2, s, status=c) for s, c in second), _nginx(3, 10), _nginx(3, 494), _nginx(3, 495))
    counts = run()
    seen = [*first, *second, (495, 200)]  # 595 was the latest, 495 is not older than the watermark
    want = _windows(seen, 60, 60) + _windows(seen, 120, 30)
    got = {(r.status_code, r.length, r.step, r.window_start): r.requests for r in counts.counts().collect()}
    assert got == want
    mark = START + dt.timedelta(seconds=max(s for s, _ in seen) - 100)
    assert all(r.closed == (r.window_start + dt.timedelta(seconds=r.length) <= mark) for r in counts.counts().collect())
    assert counts.counts(closed_only=True).count() == sum(w[3] + dt.timedelta(seconds=w[1]) <= mark for w in want)
    refused = sorted((r.raw_line, r.reason) for r in counts.quarantine().collect())
    assert refused == sorted([(_nginx(3, 10), live.LATE), (_nginx(3, 494), live.LATE), ("not a log line", "Invalid nginx log format")])
    # A batch that is tried again, with its number, leaves everything as it was.
    lines = spark.createDataFrame([(_nginx(2, s, status=c),) for s, c in second] + [(_nginx(3, s),) for s in (10, 494, 495)], "value string")
    counts.add(p.parse(lines, NGINX), 1)
    assert {(r.status_code, r.length, r.step, r.window_start): r.requests for r in counts.counts().collect()} == want


def test_a_batch_that_broke_off_is_not_read(spark, tmp_path):
    counts = live.WindowCounts(spark, str(tmp_path / "counts"), NGINX, [(60, 60)], delay=0)
    assert counts.counts().count() == 0 and counts.quarantine().count() == 0
    lines = p.parse(spark.createDataFrame([(_nginx(1, 5),)], "value string"), NGINX)
    counts.add(lines, 0)
    counts._write(counts._sums(lines.withColumn("_at", timeline.micros(lines))), "counts", 1)
    assert [r.requests for r in counts.counts().collect()] == [1]


@pytest.mark.parametrize("windows, delay", [([], 1), ([(60, 45)], 1), ([(60, 0)], 1), ([(60, 60)], -1)])
def test_windows_that_make_no_sense(spark, tmp_path, windows, delay):
    with pytest.raises(ValueError):
        live.WindowCounts(spark, str(tmp_path), NGINX, windows, delay=delay)


def _twice(run, folders, files):
    """Start, stop, put the next file of each folder in place, start again."""
    for n in range(max(map(len, files))):
        for folder, contents in zip(folders, files):
            if n < len(contents):
                _put(folder, f"access.log.{n}", *contents[n])
        run().awaitTermination()


def test_sessions_equal_the_batch(spark, folder, tmp_path):
    times = [(c, (s * (c + 3)) % 4000) for c in range(4) for s in range(0, 900, 13)]
    lines = [_nginx(c, s) for c, s in sorted(times, key=lambda x: x[1])]
    files = [lines[:100], lines[100:], [_nginx(99, 10**6)]]

    def run():
        rows = p.accepted(live.parsed_stream(spark, str(folder), NGINX, files_per_batch=1))
        return live.append_to(live.session_stream(rows, gap=40, delay=300), str(tmp_path / "out"), str(tmp_path / "checkpoint"))

    _twice(run, [folder], [files])
    batch = p.accepted(p.parse(spark.createDataFrame([(x,) for x in lines], "value string"), NGINX))
    want = sorted(tuple(r) for r in timeline.client_sessions(batch, 40).drop("session").collect())
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 8


def test_missing_requests_equal_the_anti_join(spark, tmp_path):
    left, right = tmp_path / "nginx", tmp_path / "nexus"
    left.mkdir(), right.mkdir()
    proxy = [_nginx(s % 3, s, f"/{s % 5}") for s in range(0, 700, 4)] * 2
    repository = [_nexus(s % 3, s + 3, f"/{s % 5}") for s in range(0, 700, 8)] * 3
    files = [[proxy[:150], proxy[150:], [_nginx(99, 10**6)]], [repository[:100], repository[100:], [_nexus(99, 10**6)]]]

    def run():
        rows = [p.accepted(live.parsed_stream(spark, str(f), fmt, ["access.log*"])).drop("file_source", "file_path")
                for f, fmt in ((left, NGINX), (right, NEXUS))]
        return live.append_to(live.missing_stream(*rows, seconds=3, delay=2000), str(tmp_path / "out"), str(tmp_path / "checkpoint"))

    _twice(run, [left, right], files)
    batch = [p.accepted(p.parse(spark.createDataFrame([(x,) for x in lines], "value string"), fmt))
             for lines, fmt in ((proxy, NGINX), (repository, NEXUS))]
    want = sorted(r.raw_log for r in correlate.requests_missing_in_repository(*batch, seconds=3).collect())
    assert sorted(r.raw_log for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want and want


def _missing(spark, folders, tmp_path, files_per_batch):
    rows = [p.accepted(live.parsed_stream(spark, str(f), fmt, ["access.log*"], files_per_batch)).drop("file_source", "file_path")
            for f, fmt in zip(folders, (NGINX, NEXUS))]
    query = live.append_to(live.missing_stream(*rows, seconds=3, delay=2000), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    return query


def _never_arrived(spark, tmp_path):
    """Both folders with logs, and the lines the anti join finds."""
    folders = tmp_path / "nginx", tmp_path / "nexus"
    logs = ([_nginx(s % 3, s, f"/{s % 5}") for s in range(0, 700, 4)] * 2, [_nexus(s % 3, s + 3, f"/{s % 5}") for s in range(0, 700, 8)] * 3)
    for folder, lines in zip(folders, logs):
        folder.mkdir()
        for n in range(3):
            _put(folder, f"access.log.{n}", *lines[n::3])
    batch = [p.accepted(p.parse(spark.createDataFrame([(x,) for x in lines], "value string"), fmt))
             for lines, fmt in zip(logs, (NGINX, NEXUS))]
    return folders, sorted(r.raw_log for r in correlate.requests_missing_in_repository(*batch, seconds=3).collect())


def _close(folders):
    for folder, line in zip(folders, (_nginx(99, 10**6), _nexus(99, 10**6))):
        _put(folder, "access.log.9", line)


def test_requests_wait_in_files_not_in_executors_memory(spark, tmp_path):
    folders, want = _never_arrived(spark, tmp_path)
    queries = [_missing(spark, folders, tmp_path, 1)]
    assert not spark.read.parquet(str(tmp_path / "out")).count()
    _close(folders)
    queries.append(_missing(spark, folders, tmp_path, 1))
    assert sorted(r.raw_log for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want and want
    held = [op.numRowsTotal for query in queries for progress in query.recentProgress for op in progress.stateOperators]
    assert sum(held) == 0
    assert spark.read.parquet(str(tmp_path / "checkpoint" / "missing" / "step=*" / "*")).count() == 2  # the last line of each log is open


@pytest.mark.parametrize("where", ["write_small", "rename", "remove_folder"])
def test_missing_requests_are_given_out_once_whatever_breaks_off(spark, tmp_path, monkeypatch, where):
    folders, want = _never_arrived(spark, tmp_path)
    _missing(spark, folders, tmp_path, 1000)
    _close(folders)
    real, calls = getattr(live, where), []

    def breaks(spark, path, *rest):  # at the second run's end, when what is final is written aside
        if "_step-3" in path or path.endswith("/3.json"):
            calls.append(path)
            raise RuntimeError("broke off")
        return real(spark, path, *rest)

    monkeypatch.setattr(live, where, breaks)
    with pytest.raises(Exception, match="broke off"):
        _missing(spark, folders, tmp_path, 1000)
    monkeypatch.setattr(live, where, real)
    assert calls
    _missing(spark, folders, tmp_path, 1000)
    assert sorted(r.raw_log for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
