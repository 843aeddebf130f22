"""Table schemas. `id` is the surrogate key; a field marked not-null is checked while parsing."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(spec: str) -> T.StructType:
    """Build a schema from lines `name type` where a trailing `!` marks a not-null column."""
    kinds = {
        "long": T.LongType(),
        "int": T.IntegerType(),
        "string": T.StringType(),
        "time": T.TimestampNTZType(),
        "date": T.DateType(),
    }
    fields = []
    for line in spec.strip().splitlines():
        name, kind = line.split()
        fields.append(T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


NGINX_LOGS = _table("""
    id long!
    ip_address string!
    remote_user string
    timestamp time!
    method string!
    path string!
    http_version string!
    status_code int!
    response_size long
    referer string
    user_agent string
    raw_log string!
    file_source string!
    created_at time
""")

NEXUS_LOGS = _table("""
    id long!
    ip_address string!
    remote_user string
    timestamp time!
    method string!
    path string!
    http_version string!
    status_code int!
    response_size long
    request_size long
    processing_time_ms long
    user_agent string
    thread_info string
    raw_log string!
    file_source string!
    created_at time
""")

CUSTOM_SERVICE_LOGS = _table("""
    id long!
    timestamp time!
    level string!
    user_id string
    action string!
    endpoint string
    response_time_ms long
    ip_address string
    raw_log string!
    file_source string!
    created_at time
""")

#: Every rejected line and every file or archive member that could not be taken.
LOG_QUARANTINE = _table("""
    format string!
    file_source string
    raw_line string
    reason string!
    ingested_at time
""")

#: What the readers hand to the parser. `problem` is set, and `value` null, for something
#: that was skipped: an unreadable archive, an unsafe member name, nesting that goes too deep.
RAW_LINES = _table("""
    value string
    file_source string
    file_path string
    problem string
""")
