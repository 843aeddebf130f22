"""Log formats as data: a pattern, its capture groups, and the columns built from them.

A format is declared once; reading, parsing, quarantine, statistics, storage and streaming
work from the declaration. `register` adds a format of one's own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from weblens import schemas
from weblens.functions import (
    classify_request, clf_time, iso_time, without_zone, zone_offset,
)

Groups = Mapping[str, Column]


@dataclass(frozen=True)
class LogFormat:
    """How to recognise and read one kind of log line.

    `pattern` must start at the beginning of the line (`^`); text after it is ignored.
    `groups` names its capture groups in order; a group that took no part is the empty string.
    `columns` turns groups into typed columns. `checks` lists the columns that must not be
    NULL, each with the reason a line is rejected for otherwise. A format that is to be stored
    needs a column `timestamp`, and every other column of `schema` but `id`, `raw_log`,
    `file_source` and `created_at`, which are added.
    """

    name: str
    table_name: str
    schema: T.StructType
    globs: tuple[str, ...]
    pattern: str
    groups: tuple[str, ...]
    columns: Callable[[Groups], dict[str, Column]]
    no_match: str
    checks: tuple[tuple[str, str], ...] = ()


def integer(text: Column) -> Column:
    """A whole number, NULL for `-` and for anything that is none."""
    return text.try_cast("long")


def unless_dash(text: Column) -> Column:
    return F.nullif(text, F.lit("-"))


def unless_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# The bracketed stamp. Its pieces are captured here so that one pass over the line yields
# the time as well; a stamp of another shape still lets the line match.
STAMP = (
    r"(?:(\d{1,2})/([A-Za-z]{3})/((?!0000)\d{4}):(\d{1,2}:\d{1,2}:\d{1,2})(?: ([^\]]*))?"
    r"|[^\]]+)"
)
STAMP_GROUPS = ("day", "month", "year", "clock", "zone")


def stamp_time(g: Groups) -> Column:
    return clf_time(g["day"], g["month"], g["year"], g["clock"])


# --- nginx, combined format -----------------------------------------------------------------

# What a line must look like, and the reasons recorded for lines that fail.
NGINX_PATTERN = (
    r"^(\S+) (\S+) (\S+) "
    rf"\[{STAMP}\] "
    r'"((?:([^ "]*) ([^ "]*) (HTTP/[^"]*))|[^"]*)" '
    r'(\d+) (\S+) "([^"]*)" "([^"]*)"'
)
NGINX_GLOBS = ("access.log*",)
NO_NGINX_MATCH = "Invalid nginx log format"
BAD_TIME = "Invalid timestamp format"
BAD_STATUS = "Invalid status code"


def _nginx_columns(g: Groups) -> dict[str, Column]:
    method, path, version = classify_request(g["request"], g["verb"], g["target"], g["version"])
    return {
        "ip_address": g["client"],
        "remote_user": unless_dash(g["ident"]),
        "timestamp": stamp_time(g),
        "method": method,
        "path": path,
        "http_version": version,
        "status_code": g["status"].try_cast("int"),
        "response_size": integer(g["size"]),
        "referer": unless_dash(g["referer"]),
        "user_agent": g["agent"],
        "auth_user": unless_dash(g["user"]),
        "tz_offset": zone_offset(g["zone"]),
    }


NGINX = LogFormat(
    name="nginx",
    table_name="nginx_logs",
    schema=schemas.NGINX_LOGS,
    globs=NGINX_GLOBS,
    pattern=NGINX_PATTERN,
    groups=("client", "ident", "user", *STAMP_GROUPS, "request", "verb", "target", "version",
            "status", "size", "referer", "agent"),
    columns=_nginx_columns,
    no_match=NO_NGINX_MATCH,
    checks=(("timestamp", BAD_TIME), ("status_code", BAD_STATUS)),
)

# --- Nexus, request log ---------------------------------------------------------------------

# Fixed values. The agent is captured with its quotes, which tells an empty one from none;
# the blank before the thread is required even where the thread is missing.
NEXUS_PATTERN = (
    r"^(\S+) - (\S+) "
    rf"\[({STAMP})\] "
    r'"(\S+) (\S+) ([^"]+)" '
    r'(\d+) (\d+|-) (\d+|-) (\d+|-)(?: ("[^"]*"))? (?:\[([^\]]+)\])?'
)
NEXUS_GLOBS = ("request*.log*", "nexus_logs_*.tar", "nexus_logs_*.tar.gz")
NO_NEXUS_MATCH = "Invalid Nexus log format"


def nexus_time(stamp: Column, clf: Column) -> Column:
    """Time of a Nexus stamp: common log format (`clf`, taken apart already) or an ISO shape."""
    looks_clf = F.contains(stamp, F.lit("/")) & F.contains(stamp, F.lit(":"))
    return F.when(looks_clf, clf).otherwise(iso_time(without_zone(stamp)))


def _nexus_columns(g: Groups) -> dict[str, Column]:
    quoted = g["agent"]
    agent = F.when(quoted != "", F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    return {
        "ip_address": g["client"],
        "remote_user": g["user"],
        "timestamp": nexus_time(g["stamp"], stamp_time(g)),
        "method": g["verb"],
        "path": g["target"],
        "http_version": g["version"],
        "status_code": g["status"].try_cast("int"),
        "response_size": integer(g["sent"]),
        "request_size": integer(g["received"]),
        "processing_time_ms": integer(g["millis"]),
        "user_agent": agent,
        "thread_info": unless_empty(g["thread"]),
        "tz_offset": zone_offset(g["zone"]),
    }


NEXUS = LogFormat(
    name="nexus",
    table_name="nexus_logs",
    schema=schemas.NEXUS_LOGS,
    globs=NEXUS_GLOBS,
    pattern=NEXUS_PATTERN,
    groups=("client", "user", "stamp", *STAMP_GROUPS, "verb", "target", "version", "status",
            "sent", "received", "millis", "agent", "thread"),
    columns=_nexus_columns,
    no_match=NO_NEXUS_MATCH,
    checks=(("timestamp", BAD_TIME), ("status_code", BAD_STATUS)),
)

# --- an application log, the worked example of a format of one's own -------------------------

# The line, and the two shapes of message that are taken apart further.
CUSTOM_SERVICE_PATTERN = r"^\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (.*\S)"
USER_ACTION = r"(\w+) (\w+) (/[\w/]*)(?: - response_time: (\d+)ms)?"
FAILURE = r"(\w+) for (\w+) from ([\d.]+)"
CUSTOM_SERVICE_GLOBS = ("custom_service*.log", "service_*.log")


def _custom_service_columns(g: Groups) -> dict[str, Column]:
    message = g["message"]
    access = F.contains(message, F.lit("accessed"))
    failure = ~access & F.contains(message, F.lit("failed"))

    def pick(action_group: int | None, failure_group: int | None) -> Column:
        out = F.lit("")
        if failure_group:
            out = F.when(failure, F.regexp_extract(message, FAILURE, failure_group)).otherwise(out)
        if action_group:
            out = F.when(access, F.regexp_extract(message, USER_ACTION, action_group)).otherwise(out)
        return out

    return {
        "timestamp": iso_time(g["stamp"]),
        "level": g["level"],
        "user_id": unless_empty(pick(1, 2)),
        "action": pick(2, 1),
        "endpoint": unless_empty(pick(3, None)),
        "response_time_ms": integer(pick(4, None)),
        "ip_address": unless_empty(pick(None, 3)),
    }


CUSTOM_SERVICE = LogFormat(
    name="custom_service",
    table_name="custom_service_logs",
    schema=schemas.CUSTOM_SERVICE_LOGS,
    globs=CUSTOM_SERVICE_GLOBS,
    pattern=CUSTOM_SERVICE_PATTERN,
    groups=("stamp", "level", "message"),
    columns=_custom_service_columns,
    no_match="Invalid log format",
    checks=(("timestamp", "Invalid timestamp"),),
)

# --- registry -------------------------------------------------------------------------------

FORMATS: dict[str, LogFormat] = {}


def register(fmt: LogFormat) -> LogFormat:
    """Make a format known by name; a name can be taken only once."""
    if fmt.name in FORMATS:
        raise ValueError(f"log format {fmt.name!r} is registered already")
    if not fmt.pattern.startswith("^"):
        raise ValueError("a log pattern must be anchored with '^'")
    FORMATS[fmt.name] = fmt
    return fmt


for _fmt in (NGINX, NEXUS, CUSTOM_SERVICE):
    register(_fmt)
