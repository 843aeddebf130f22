"""Random lines against a plain restatement in Python: same fields, same rejects."""

from __future__ import annotations

import random
import re
from datetime import datetime

from weblens.formats import FORMATS
from weblens.operators import parse as p

NGINX = re.compile(
    r'(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d+) (\S+) "([^"]*)" "([^"]*)"', re.ASCII)
NEXUS = re.compile(
    r'(\S+) - (\S+) \[([^\]]+)\] "(\S+) (\S+) ([^"]+)" (\d+) (\d+|-) (\d+|-) (\d+|-)(?: "([^"]*)")? (?:\[([^\]]+)\])?',
    re.ASCII)


def when(text, layout):
    try:
        return datetime.strptime(text, layout)
    except ValueError:
        return None


def clf(stamp):
    return when(stamp.partition(" ")[0], "%d/%b/%Y:%H:%M:%S")


def nexus_time(stamp):
    if "/" in stamp and ":" in stamp:
        return clf(stamp)
    for mark in ",+":
        if mark in stamp:
            stamp = stamp.partition(mark)[0]
            break
    else:
        if stamp.count("-") > 2:
            stamp = stamp.rpartition("-")[0]
    return when(stamp, "%Y-%m-%d %H:%M:%S")


def number(text):
    return int(text) if re.fullmatch(r"[+-]?\d+", text, re.ASCII) else None


def request_of(text):
    words = text.split(" ", 2)
    if len(words) == 3 and words[2][:5] == "HTTP/":
        return tuple(words)
    short = text if len(text) <= 50 else text[:50] + "..."
    if text[:4] == "SSH-":
        return "SSH-ATTEMPT", text, "NON-HTTP"
    if text[:1] == "{" or "method" in text:
        return "JSON-RPC", short, "NON-HTTP"
    if not all(" " <= c <= "~" for c in text):
        return "BINARY-DATA", "[BINARY]", "NON-HTTP"
    return "MALFORMED", short, "NON-HTTP"


def nginx_row(text):
    found = NGINX.match(text)
    if not found:
        return "Invalid nginx log format"
    ip, ident, login, stamp, request, status, size, referer, agent = found.groups()
    time = clf(stamp)
    if time is None:
        return "Invalid timestamp format"
    return (ip, None if ident == "-" else ident, time, *request_of(request), int(status), number(size),
            None if referer == "-" else referer, agent, None if login == "-" else login)


def nexus_row(text):
    found = NEXUS.match(text)
    if not found:
        return "Invalid Nexus log format"
    ip, user, stamp, verb, path, version, status, sent, received, millis, agent, thread = found.groups()
    time = nexus_time(stamp)
    if time is None:
        return "Invalid timestamp format"
    return ip, user, time, verb, path, version, int(status), number(sent), number(received), number(millis), agent, thread


NGINX_COLUMNS = ("ip_address remote_user timestamp method path http_version status_code response_size"
                 " referer user_agent auth_user").split()
NEXUS_COLUMNS = ("ip_address remote_user timestamp method path http_version status_code response_size"
                 " request_size processing_time_ms user_agent thread_info").split()

STAMPS = ["29/May/2025:14:30:45 -0400", "1/jan/2024:1:02:3", "31/Feb/2025:00:00:00 +0000", "29/May/2025:14:30:45x",
          "2025-05-29 12:34:56,123+0000", "2025-05-29 12:34:56-0500", "2025-05-29 12:34:56", "2025-05-29 12:34:61",
          "x", "/:", "29/May/2025:25:00:00 +0000", "29/May/2025:14:30:45  ", "2025-13-01 00:00:00", "a,b+c-d",
          "2025-05-29  12:34:56", "29/May/2025", "29/May/2025:14:30:45 [+0"]
WORDS = ["-", "a", "10.0.0.1", "::1", "user", "é", "a\"b", "", "x y", "[", "]", "\\", "$1"]
REQUESTS = ["GET /a HTTP/1.1", "GET  /a HTTP/1.1", "HTTP/1.1", "a b HTTP/", "a b HTTP/1.1 c", "a b c HTTP/1.1", "SSH-2",
            "SSH- x HTTP/1.1", "{}", "{ a HTTP/1", "my method", "\x01 b c", "café", "y" * 51, "z" * 50, "", " ", "  ",
            "\U0001f600" * 30 + " x", "$1 \\2 HTTP/1.0", "GET /\t HTTP/1.1", "GET /a b HTTP/1.1"]
NUMBERS = ["200", "0", "-", "12", "abc", "+5", "-5", "1.5", "999999999", "12 ", ""]
TAILS = ["", " ", ' "A/1"', ' "A/1" ', ' "" [t]', ' "A" [t 1]', " [t]", " []", ' "A [t]', "  [t]", ' "A" [t] more', ' "A"[t]']


def compare(spark, name, lines, model, columns):
    frame = spark.createDataFrame(list(enumerate(lines)), "n int, value string").repartition(8)
    rows = {r.n: r for r in p.parse(frame, FORMATS[name]).collect()}
    for n, text in enumerate(lines):
        if not text.strip():
            assert n not in rows
            continue
        expected, row = model(text), rows[n]
        found = row.reason or tuple(row[c] for c in columns)
        assert found == expected, text


def test_nginx(spark):
    draw = random.Random(11)
    pick = draw.choice
    lines = []
    for _ in range(15000):
        gap = pick([" "] * 30 + ["", "  "])
        lines.append(
            f'{pick(WORDS)} {pick(WORDS)}{gap}{pick(WORDS)} [{pick(STAMPS)}] "{pick(REQUESTS)}" {pick(NUMBERS)}'
            f' {pick(NUMBERS)}{gap}"{pick(WORDS)}" "{pick(WORDS)}"{pick(["", "", " tail", "x"])}')
    good = sum(isinstance(nginx_row(text), tuple) for text in lines)
    assert good > 200
    compare(spark, "nginx", lines, nginx_row, NGINX_COLUMNS)


def test_nexus(spark):
    draw = random.Random(12)
    pick = draw.choice
    lines = []
    for _ in range(15000):
        lines.append(
            f'{pick(WORDS)} - {pick(WORDS)} [{pick(STAMPS)}] "{pick(REQUESTS)}" {pick(NUMBERS)}'
            f' {pick(["1", "-", "77"])} {pick(["1", "-"])} {pick(["5", "-", "x"])}{pick(TAILS)}')
    good = sum(isinstance(nexus_row(text), tuple) for text in lines)
    assert good > 50
    compare(spark, "nexus", lines, nexus_row, NEXUS_COLUMNS)
