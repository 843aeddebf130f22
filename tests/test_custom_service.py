"""The example of a format of one's own, and the registry."""

from __future__ import annotations

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from weblens import formats
from weblens.operators import parse as p, traffic


def test_user_action(parse_lines):
    text = "2024-01-15 10:30:45 [INFO] user123 accessed /api/data - response_time: 250ms"
    row = parse_lines("custom_service", text)[0]
    assert row.timestamp == dt.datetime(2024, 1, 15, 10, 30, 45)
    assert (row.level, row.user_id, row.action) == ("INFO", "user123", "accessed")
    assert (row.endpoint, row.response_time_ms, row.ip_address) == ("/api/data", 250, None)


def test_failure(parse_lines):
    text = "2024-01-15 10:31:12 [ERROR] authentication_failed for user456 from 192.168.1.100"
    row = parse_lines("custom_service", text)[0]
    assert (row.level, row.action, row.user_id) == ("ERROR", "authentication_failed", "user456")
    assert (row.ip_address, row.endpoint) == ("192.168.1.100", None)


def test_other_messages_and_rejects(parse_lines):
    rows = parse_lines(
        "custom_service",
        "2024-01-15 10:31:12 [WARN] disk is full  ",
        "  2024-01-15 10:31:12 [INFO] user1 accessed /a",
        "invalid log format",
        "2024-02-30 10:31:12 [INFO] user1 accessed /a",
        "2024-01-15 10:31:12 [INFO] ",
    )
    assert rows[0].action == "" and rows[0].reason is None
    assert (rows[1].endpoint, rows[1].response_time_ms) == ("/a", None)
    assert [r.reason for r in rows[2:]] == [
        "Invalid log format", "Invalid timestamp", "Invalid log format"]


def test_failures_by_action(spark):
    rows = [("2024-01-15 10:31:12 [ERROR] login_failed for u from 1.1.1.1",)] * 2 + [
        ("2024-01-15 10:31:12 [ERROR] save_failed for u from 1.1.1.1",),
        ("2024-01-15 10:31:12 [INFO] retry_failed for u from 1.1.1.1",)]
    logs = p.accepted(p.parse(spark.createDataFrame(rows, "value string"), formats.CUSTOM_SERVICE))
    found = [tuple(r) for r in traffic.failures_by_action(logs).collect()]
    assert found == [("login_failed", 2), ("save_failed", 1)]


def test_registering_a_format(spark):
    schema = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("text", T.StringType())])
    fmt = formats.LogFormat(
        name="tiny", table_name="tiny_logs", schema=schema, globs=("tiny*.log",),
        pattern=r"^(\d+)(?: (\w+))?", groups=("code", "text"),
        columns=lambda g: {"code": g["code"].try_cast("int"), "text": formats.unless_empty(g["text"])},
        no_match="no", checks=(("code", "too large"),),
    )
    try:
        assert formats.register(fmt) is formats.FORMATS["tiny"]
        with pytest.raises(ValueError):
            formats.register(fmt)
        with pytest.raises(ValueError):
            formats.register(dataclasses.replace(fmt, name="loose", pattern="x"))
        lines = spark.createDataFrame([("7 a",), ("8",), ("x",), ("99999999999",)], "value string")
        rows = p.parse(lines, fmt).orderBy(F.col("code").asc_nulls_last(), "reason").collect()
        assert [(r.code, r.text, r.reason) for r in rows] == [
            (7, "a", None), (8, None, None), (None, None, "no"), (None, None, "too large")]
    finally:
        formats.FORMATS.pop("tiny", None)
