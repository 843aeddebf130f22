"""Golden lines of the repository log."""

from __future__ import annotations

import datetime as dt

import pytest

MAVEN = ('10.0.0.1 - testuser [28/May/2025:14:30:45 +0000] "GET /repository/maven-public/org/a/a.jar'
         ' HTTP/1.1" 200 1234567 152 89 "Maven/3.8.1" [qtp123456789-42]')
HEAD = '10.0.0.1 - {user} [{stamp}] "GET /repository/npm HTTP/1.1" 200 {sizes}'


def line(user="u", stamp="28/May/2025:14:30:45 +0000", sizes="10 20 30", rest=' "A/1" [qtp1-1]'):
    return HEAD.format(user=user, stamp=stamp, sizes=sizes) + rest


def test_full_line(parse_lines):
    row = parse_lines("nexus", MAVEN)[0]
    assert row.reason is None
    assert (row.ip_address, row.remote_user) == ("10.0.0.1", "testuser")
    assert row.timestamp == dt.datetime(2025, 5, 28, 14, 30, 45)
    assert (row.method, row.path) == ("GET", "/repository/maven-public/org/a/a.jar")
    assert (row.http_version, row.status_code) == ("HTTP/1.1", 200)
    assert (row.response_size, row.request_size, row.processing_time_ms) == (1234567, 152, 89)
    assert (row.user_agent, row.thread_info) == ("Maven/3.8.1", "qtp123456789-42")
    assert row.raw_log == MAVEN


def test_dash_user_is_kept(parse_lines):
    assert parse_lines("nexus", line(user="-"))[0].remote_user == "-"


@pytest.mark.parametrize("sizes,expected", [
    ("1073741824 2048 15000", (1073741824, 2048, 15000)),
    ("- 7927 93", (None, 7927, 93)),
    ("0 0 5", (0, 0, 5)),
    ("- - -", (None, None, None)),
])
def test_sizes(parse_lines, sizes, expected):
    row = parse_lines("nexus", line(sizes=sizes))[0]
    assert (row.response_size, row.request_size, row.processing_time_ms) == expected


@pytest.mark.parametrize("rest,expected", [
    (' "A/1" [qtp1-1]', ("A/1", "qtp1-1")),
    (' "" [qtp1-1]', ("", "qtp1-1")),
    (" [qtp1-1]", (None, "qtp1-1")),
    (' "A/1" ', ("A/1", None)),
    (" ", (None, None)),
    (' "A/1"', (None, None)),  # no blank behind the agent: the agent is lost
    (' "A/1" [qtp1-1] trailing', ("A/1", "qtp1-1")),
])
def test_optional_tail(parse_lines, rest, expected):
    row = parse_lines("nexus", line(rest=rest))[0]
    assert row.reason is None and (row.user_agent, row.thread_info) == expected


@pytest.mark.parametrize("text", [
    "completely invalid log format",
    "10.0.0.1 incomplete log",
    '10.0.0.1 - user [invalid timestamp] "GET /test" 200',
    line(rest=""),
    line(sizes="a 1 2"),
])
def test_rejected_lines(parse_lines, text):
    assert parse_lines("nexus", text)[0].reason == "Invalid Nexus log format"


NOON = dt.datetime(2025, 5, 29, 12, 34, 56)


@pytest.mark.parametrize("stamp,expected", [
    ("12/Jun/2025:09:11:00 +0000", dt.datetime(2025, 6, 12, 9, 11)),
    ("2025-05-29 12:34:56,123+0000", NOON),
    ("2025-05-29 12:34:56+0400", NOON),
    ("2025-05-29 12:34:56-0500", NOON),
    ("2025-05-29 12:34:56", NOON),
    ("2025-5-29 12:34:56", NOON),
    ("not-a-valid-timestamp", None),
    ("2025-05-29T12:34:56", None),
    ("2025-02-30 12:34:56", None),
    ("2025-05-29 12:34:60", None),
    ("2025-05-29", None),
    ("2025/05/29 12:34:56", None),
    ("31/Feb/2025:09:11:00 +0000", None),
])
def test_times(parse_lines, stamp, expected):
    row = parse_lines("nexus", line(stamp=stamp))[0]
    assert row.timestamp == expected
    assert row.reason == (None if expected else "Invalid timestamp format")
