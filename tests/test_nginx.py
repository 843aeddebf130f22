"""Golden lines of the proxy log."""

from __future__ import annotations

import datetime as dt

import pytest

LINE = '198.51.100.23 - - [07/Nov/2023:21:05:09 -0300] "{request}" {status} {size} "{referer}" "{agent}"'


def line(request="GET /pkg/lib-2.4.tgz HTTP/1.1", status="200", size="100", referer="-", agent="-"):
    return LINE.format(request=request, status=status, size=size, referer=referer, agent=agent)


def test_combined_line(parse_lines):
    text = line(size="1234", referer="https://mirror.test/index", agent="fetcher/2.1 (nightly)")
    row = parse_lines("nginx", text)[0]
    assert row.reason is None and row.outcome == "parsed"
    assert row.ip_address == "198.51.100.23"
    assert row.remote_user is None
    assert row.timestamp == dt.datetime(2023, 11, 7, 21, 5, 9)
    assert row.tz_offset == "-0300"
    assert (row.method, row.path, row.http_version) == ("GET", "/pkg/lib-2.4.tgz", "HTTP/1.1")
    assert (row.status_code, row.response_size) == (200, 1234)
    assert row.referer == "https://mirror.test/index"
    assert row.user_agent == "fetcher/2.1 (nightly)"
    assert row.raw_log == text


@pytest.mark.parametrize("size,expected", [
    ("-", None), ("abc", None), ("12.5", None), ("0", 0), ("5000000000", 5_000_000_000),
])
def test_sizes(parse_lines, size, expected):
    row = parse_lines("nginx", line(size=size))[0]
    assert row.reason is None and row.response_size == expected


def test_users_are_second_and_third_token(parse_lines):
    rows = parse_lines(
        "nginx",
        '192.0.2.7 w.fenn - [07/Nov/2023:21:05:09 -0300] "POST /u HTTP/1.1" 201 1 "-" "W"',
        '192.0.2.7 - ops7 [07/Nov/2023:21:05:09 -0300] "POST /u HTTP/1.1" 201 1 "-" "W"',
    )
    assert [(r.remote_user, r.auth_user) for r in rows] == [("w.fenn", None), (None, "ops7")]


def test_dash_agent_stays_and_dash_referer_goes(parse_lines):
    row = parse_lines("nginx", line())[0]
    assert row.referer is None and row.user_agent == "-"


@pytest.mark.parametrize("request_text,expected", [
    ("SSH-2.0-Go", ("SSH-ATTEMPT", "SSH-2.0-Go", "NON-HTTP")),
    ("SSH-2.0-" + "v" * 80, ("SSH-ATTEMPT", "SSH-2.0-" + "v" * 80, "NON-HTTP")),
    (r"{\x22call\x22:\x22queue.depth\x22,\x22args\x22:[7],\x22tag\x22:null}",
     ("JSON-RPC", r"{\x22call\x22:\x22queue.depth\x22,\x22args\x22:[7],\x22tag\x22:null}"[:50] + "...",
      "NON-HTTP")),
    ("call method now", ("JSON-RPC", "call method now", "NON-HTTP")),
    (r"\x16\x03\x01q7~", ("MALFORMED", r"\x16\x03\x01q7~", "NON-HTTP")),
    ("PUT /blob\x07\x1fzz", ("BINARY-DATA", "[BINARY]", "NON-HTTP")),
    ("GET /straße", ("BINARY-DATA", "[BINARY]", "NON-HTTP")),
    ("x" * 100, ("MALFORMED", "x" * 50 + "...", "NON-HTTP")),
    ("x" * 50, ("MALFORMED", "x" * 50, "NON-HTTP")),
    ("", ("MALFORMED", "", "NON-HTTP")),
    ("nothing like a request", ("MALFORMED", "nothing like a request", "NON-HTTP")),
    ("GET /a b HTTP/1.1", ("MALFORMED", "GET /a b HTTP/1.1", "NON-HTTP")),
    ("GET /q?x=1&y=%20 HTTP/2.0 tail", ("GET", "/q?x=1&y=%20", "HTTP/2.0 tail")),
    ("  HTTP/1.1", ("", "", "HTTP/1.1")),
    ("PATCH " + "/" + "p" * 1016 + " HTTP/1.0", ("PATCH", "/" + "p" * 1016, "HTTP/1.0")),
])
def test_requests(parse_lines, request_text, expected):
    row = parse_lines("nginx", line(request=request_text))[0]
    assert (row.method, row.path, row.http_version) == expected


@pytest.mark.parametrize("stamp,expected", [
    ("07/Nov/2023:21:05:09 -0300", dt.datetime(2023, 11, 7, 21, 5, 9)),
    ("07/NOV/2023:21:05:09", dt.datetime(2023, 11, 7, 21, 5, 9)),
    ("1/Jan/2025:1:2:3 +0000", dt.datetime(2025, 1, 1, 1, 2, 3)),
    ("09/Mar/2025:02:30:00 -0500", dt.datetime(2025, 3, 9, 2, 30)),  # skipped hour in New York
    ("29/Feb/2024:00:00:00 +0000", dt.datetime(2024, 2, 29)),
    ("29/Feb/2025:00:00:00 +0000", None),
    ("31/Apr/2025:00:00:00 +0000", None),
    ("01/Anf/2025:00:00:00 +0000", None),
    ("01/Xyz/2025:00:00:00 +0000", None),
    ("01/Jan/2025:24:00:00 +0000", None),
    ("01/Jan/2025:23:59:60 +0000", None),
    ("01/Jan/0000:00:00:00 +0000", None),
    ("00/Jan/2025:00:00:00 +0000", None),
    ("07/Nov/2023:21:05:09x", None),
    ("07/Nov/23:21:05:09 +0000", None),
    ("no time", None),
])
def test_times(spark, parse_lines, stamp, expected):
    text = f'1.1.1.1 - - [{stamp}] "GET / HTTP/1.1" 200 1 "-" "-"'
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session_zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", session_zone)
            row = parse_lines("nginx", text)[0]
            assert row.timestamp == expected
            assert row.reason == (None if expected else "Invalid timestamp format")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("text", [
    "not a log line",
    line(status="abc"),
    '198.51.100.23 - - [07/Nov/2023:21:05:09 -0300] "GET / HTTP/1.1" 200',
    '198.51.100.23 - - 07/Nov/2023:21:05:09 "GET / HTTP/1.1" 200 1 "-" "-"',
    ' ' + line(),
])
def test_rejected_lines(parse_lines, text):
    row = parse_lines("nginx", text)[0]
    assert (row.outcome, row.reason) == ("rejected", "Invalid nginx log format")
    assert row.raw_log == text


def test_status_that_is_no_int(parse_lines):
    assert parse_lines("nginx", line(status="99999999999"))[0].reason == "Invalid status code"


def test_blank_lines_are_no_lines(parse_lines):
    assert len(parse_lines("nginx", "", "   ", "\t", line())) == 1


def test_line_feed_inside_a_value_cannot_fake_fields(parse_lines):
    rows = parse_lines("nginx", "\n" * 16 + "x", line(referer="a\nb"))
    assert [r.reason for r in rows] == ["Invalid nginx log format"] * 2


def test_more_lines(parse_lines):
    ipv6 = "fd00:12:0:7::9:beef"
    rows = parse_lines(
        "nginx",
        f'{ipv6} - - [07/Nov/2023:21:05:09 -0300] "GET /six HTTP/1.1" 200 61 "-" "-"',
        line(agent='probe \\"inner\\" 3'),
        line() + ' "extra" 0.123',
    )
    assert rows[0].ip_address == ipv6
    assert rows[1].user_agent == "probe \\"
    assert rows[2].reason is None
