"""Each registered query as DuckDB SQL over the same files.

The statements take the lines apart on their own terms: plain patterns with one group per
field, `strptime` for times, string functions for requests.
"""

from __future__ import annotations

from weblens import schemas
from weblens.plans.samples import FILE_LINES, expressions

DIALECT = {
    "STR": "VARCHAR",
    "CLF": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
    "CLF1": "strftime(ts + INTERVAL '1' SECOND, '%d/%b/%Y:%H:%M:%S')",
    "ISO": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
}

# The line patterns, one group per field.
NGINX_PATTERN = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d+) (\S+) "([^"]*)" "([^"]*)"'
NEXUS_PATTERN = (
    r'^(\S+) - (\S+) \[([^\]]+)\] "(\S+) (\S+) ([^"]+)" (\d+) (\d+|-) (\d+|-) (\d+|-)'
    r'(?: ("[^"]*"))? (?:\[([^\]]+)\])?'
)
CUSTOM_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (.*)"
ACTION_PATTERN = r"(\w+) (\w+) (/[\w/]*)(?: - response_time: (\d+)ms)?"
FAILURE_PATTERN = r"(\w+) for (\w+) from ([\d.]+)"


def _groups(text: str, pattern: str, names: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names.split())
    return f"regexp_extract({text}, '{pattern}', [{listed}])"


def _lines(name: str) -> str:
    return f"SELECT {', '.join(expressions(name, DIALECT))} FROM events"


def _clf(stamp: str) -> str:
    return f"try_strptime(split_part({stamp}, ' ', 1), '%d/%b/%Y:%H:%M:%S')"


def _zone(stamp: str) -> str:
    return f"nullif(regexp_extract({stamp}, ' ([+-]\\d{{4}})$', 1), '')"


_CUT = "CASE WHEN length({0}) > {1} THEN substring({0}, 1, {1}) || '...' ELSE {0} END"

NGINX = rf"""
nginx_lines AS ({_lines('nginx')}),
nginx_taken AS (
  SELECT event_id AS id, file_source, line AS raw_log, regexp_matches(line, '{NGINX_PATTERN}') AS ok,
    {_groups('line', NGINX_PATTERN, 'ip ident login stamp req status size referer agent')} AS g
  FROM nginx_lines WHERE regexp_matches(line, '\S')),
nginx_all AS (
  SELECT id, file_source, raw_log,
    CASE WHEN NOT ok THEN 'Invalid nginx log format'
         WHEN {_clf('g.stamp')} IS NULL THEN 'Invalid timestamp format' END AS reason,
    g.ip AS ip_address, nullif(g.ident, '-') AS remote_user, {_clf('g.stamp')} AS timestamp,
    CASE WHEN regexp_matches(g.req, '^[^ ]* [^ ]* HTTP/') THEN split_part(g.req, ' ', 1)
         WHEN starts_with(g.req, 'SSH-') THEN 'SSH-ATTEMPT'
         WHEN starts_with(g.req, '{{') OR contains(g.req, 'method') THEN 'JSON-RPC'
         WHEN regexp_matches(g.req, '[^\x20-\x7e]') THEN 'BINARY-DATA'
         ELSE 'MALFORMED' END AS method,
    CASE WHEN regexp_matches(g.req, '^[^ ]* [^ ]* HTTP/') THEN split_part(g.req, ' ', 2)
         WHEN starts_with(g.req, 'SSH-') THEN g.req
         WHEN starts_with(g.req, '{{') OR contains(g.req, 'method') THEN {_CUT.format('g.req', 50)}
         WHEN regexp_matches(g.req, '[^\x20-\x7e]') THEN '[BINARY]'
         ELSE {_CUT.format('g.req', 50)} END AS path,
    CASE WHEN regexp_matches(g.req, '^[^ ]* [^ ]* HTTP/')
         THEN regexp_extract(g.req, '^[^ ]* [^ ]* (.*)$', 1) ELSE 'NON-HTTP' END AS http_version,
    TRY_CAST(g.status AS INTEGER) AS status_code, TRY_CAST(g.size AS BIGINT) AS response_size,
    nullif(g.referer, '-') AS referer, g.agent AS user_agent, nullif(g.login, '-') AS auth_user,
    {_zone('g.stamp')} AS tz_offset
  FROM nginx_taken),
nginx_logs AS (SELECT * EXCLUDE (reason) FROM nginx_all WHERE reason IS NULL)"""

NEXUS = rf"""
nexus_lines AS ({_lines('nexus')}),
nexus_taken AS (
  SELECT event_id AS id, file_source, line AS raw_log, regexp_matches(line, '{NEXUS_PATTERN}') AS ok,
    {_groups('line', NEXUS_PATTERN,
             'ip usr stamp verb target version status sent received millis agent thread')} AS g
  FROM nexus_lines WHERE regexp_matches(line, '\S')),
nexus_all AS (
  SELECT id, file_source, raw_log,
    CASE WHEN NOT ok THEN 'Invalid Nexus log format'
         WHEN {_clf('g.stamp')} IS NULL THEN 'Invalid timestamp format' END AS reason,
    g.ip AS ip_address, g.usr AS remote_user, {_clf('g.stamp')} AS timestamp, g.verb AS method,
    g.target AS path, g.version AS http_version, TRY_CAST(g.status AS INTEGER) AS status_code,
    TRY_CAST(g.sent AS BIGINT) AS response_size, TRY_CAST(g.received AS BIGINT) AS request_size,
    TRY_CAST(g.millis AS BIGINT) AS processing_time_ms,
    CASE WHEN g.agent <> '' THEN substring(g.agent, 2, length(g.agent) - 2) END AS user_agent,
    nullif(g.thread, '') AS thread_info, {_zone('g.stamp')} AS tz_offset
  FROM nexus_taken),
nexus_logs AS (SELECT * EXCLUDE (reason) FROM nexus_all WHERE reason IS NULL)"""

CUSTOM = rf"""
custom_lines AS ({_lines('custom_service')}),
custom_taken AS (
  SELECT event_id AS id, file_source, line AS raw_log,
    regexp_matches(trim(line), '{CUSTOM_PATTERN}') AS ok,
    {_groups('trim(line)', CUSTOM_PATTERN, 'stamp level message')} AS g
  FROM custom_lines WHERE regexp_matches(line, '\S')),
custom_message AS (
  SELECT *, contains(g.message, 'accessed') AS access,
    NOT contains(g.message, 'accessed') AND contains(g.message, 'failed') AS failure,
    {_groups('g.message', ACTION_PATTERN, 'usr action endpoint millis')} AS a,
    {_groups('g.message', FAILURE_PATTERN, 'action usr ip')} AS f
  FROM custom_taken),
custom_all AS (
  SELECT id, file_source, raw_log,
    CASE WHEN NOT ok THEN 'Invalid log format'
         WHEN try_strptime(g.stamp, '%Y-%m-%d %H:%M:%S') IS NULL THEN 'Invalid timestamp' END AS reason,
    try_strptime(g.stamp, '%Y-%m-%d %H:%M:%S') AS timestamp, g.level AS level,
    nullif(CASE WHEN access THEN a.usr WHEN failure THEN f.usr ELSE '' END, '') AS user_id,
    CASE WHEN access THEN a.action WHEN failure THEN f.action ELSE '' END AS action,
    CASE WHEN access THEN nullif(a.endpoint, '') END AS endpoint,
    CASE WHEN access THEN TRY_CAST(a.millis AS BIGINT) END AS response_time_ms,
    CASE WHEN failure THEN nullif(f.ip, '') END AS ip_address
  FROM custom_message),
custom_service_logs AS (SELECT * EXCLUDE (reason) FROM custom_all WHERE reason IS NULL)"""


def _with(query: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + query


def _nginx(query: str) -> str:
    return _with(query, NGINX)


def _nexus(query: str) -> str:
    return _with(query, NEXUS)


def _custom(query: str) -> str:
    return _with(query, CUSTOM)


def _both(query: str) -> str:
    return _with(query, NGINX, NEXUS)


def _quarantine(name: str, table: str) -> str:
    return (f"SELECT '{name}' AS format, file_source, raw_log AS raw_line, reason FROM {table}"
            " WHERE reason IS NOT NULL")


_STORED_NGINX = "SELECT * EXCLUDE (id, file_source) FROM nginx_logs"
_REPOSITORY = "nullif(regexp_extract(path, '^/repository/([^/]+)', 1), '')"
_ACTION = ("CASE WHEN method IN ('GET', 'HEAD') THEN 'download' WHEN method IN ('PUT', 'POST')"
           " THEN 'upload' WHEN method = 'DELETE' THEN 'delete' ELSE 'other' END")
_PER_FILE = """
  SELECT format, file_source, count(*) FILTER (reason IS NULL) AS entries,
    count(*) FILTER (reason IS NOT NULL) AS parse_errors, count(*) AS lines
  FROM (SELECT 'nginx' AS format, file_source, reason FROM nginx_all
        UNION ALL SELECT 'nexus', file_source, reason FROM nexus_all) GROUP BY ALL"""
_TOTALS = f"""
  SELECT format, count(*) AS files, sum(entries)::BIGINT AS entries,
    sum(parse_errors)::BIGINT AS parse_errors, sum(lines)::BIGINT AS lines,
    sum(entries)::DOUBLE / sum(lines)::DOUBLE AS success_rate
  FROM ({_PER_FILE}) GROUP BY ROLLUP (format)"""


#: The sample file that an event is in, and whether it is among the odd ones of its lines.
_FILE = f"id // {FILE_LINES}"
_ODD = f"id % {FILE_LINES} % 2 = 1"


def _from_files(source: str, where: str = "true", path: str = "path", raw_log: str = "raw_log") -> str:
    """Good lines as read from sample files; `source` is their `file_source`."""
    return _nginx(f"SELECT * EXCLUDE (id, file_source) REPLACE ({path} AS path, {raw_log} AS raw_log), 'nginx:' || {source} AS file_source"
                  f" FROM nginx_logs WHERE {where}")


def _skipped(values: str, where: str = "true") -> str:
    """A row for each sample file and each (source, reason) of it."""
    return (f"SELECT 'nginx:' || source AS file_source, reason FROM (SELECT DISTINCT event_id // {FILE_LINES} AS n FROM events) f,"
            f" LATERAL (VALUES {values}) v(source, reason) WHERE {where}")


_BROKEN = "replace({0}, '/repository/', '/repository/' || chr(65533) || chr(65533))"


def _statistics(table: str) -> str:
    return (f"SELECT '{table}' AS table_name, count(*) AS total_entries,"
            " count(DISTINCT ip_address) AS unique_ips,"
            " count(DISTINCT CAST(timestamp AS DATE)) AS unique_days,"
            f" min(timestamp) AS earliest_log, max(timestamp) AS latest_log FROM {table}")


def _profile(table: str, schema: schemas.T.StructType, extra: list[tuple[str, str]]) -> str:
    kept = [f for f in schema.fields if f.name != "created_at"]
    rows = [(f.name, f.dataType.simpleString(), not f.nullable, f.name == "id") for f in kept]
    rows += [(name, kind, False, False) for name, kind in extra]
    values = ", ".join(
        f"({i}, '{n}', '{k}', {str(required).lower()}, {str(key).lower()})"
        for i, (n, k, required, key) in enumerate(rows)
    )
    return (f"SELECT '{table}' AS table_name, v.*, (SELECT count(*) FROM {table}) AS row_count"
            f" FROM (VALUES {values}) v(position, column_name, data_type, not_null, primary_key)")


def _near(seconds: int) -> str:
    return ("x.ip_address = n.ip_address AND x.method = n.method AND x.path = n.path"
            f" AND abs(epoch(x.timestamp) - epoch(n.timestamp)) <= {seconds}")


STAMPS = f"""
WITH stamps AS ({_lines('stamps')})
SELECT event_id, stamp, CASE
  WHEN contains(stamp, '/') AND contains(stamp, ':') THEN {_clf('stamp')}
  WHEN contains(stamp, ',') THEN try_strptime(split_part(stamp, ',', 1), '%Y-%m-%d %H:%M:%S')
  WHEN contains(stamp, '+') THEN try_strptime(split_part(stamp, '+', 1), '%Y-%m-%d %H:%M:%S')
  WHEN length(stamp) - length(replace(stamp, '-', '')) >= 3
    THEN try_strptime(regexp_replace(stamp, '-[^-]*$', ''), '%Y-%m-%d %H:%M:%S')
  ELSE try_strptime(stamp, '%Y-%m-%d %H:%M:%S') END AS timestamp
FROM stamps"""

_SIZE = """CASE WHEN coalesce(response_size, 0) = 0 THEN '-'
  WHEN response_size < 1024 THEN response_size || 'B'
  WHEN response_size < 1048576
    THEN printf('%.1f', floor(response_size / 1024.0::DOUBLE * 10 + 0.5) / 10) || 'KB'
  ELSE printf('%.1f', floor(response_size / 1048576.0::DOUBLE * 10 + 0.5) / 10) || 'MB' END"""

START, END = "2024-01-10 06:00:00", "2024-01-12 18:30:00"
NOW = "2024-01-20 12:00:00"

NGINX_PREVIEW = "id ip_address remote_user method path http_version status_code response_size referer user_agent file_source"
NEXUS_PREVIEW = ("id ip_address remote_user method path http_version status_code response_size"
                 " request_size processing_time_ms user_agent thread_info file_source")


def _preview(columns: str, table: str) -> str:
    return (f"SELECT {', '.join(columns.split())},"
            f" strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM {table}"
            " ORDER BY id DESC LIMIT 10")


def _paired(seconds: int) -> str:
    """One-to-one pairing as a sequential matcher: one step at a time along both logs of each key."""
    def sides(table: str, letter: str) -> str:
        return (f"SELECT ip_address, method, path, list(id ORDER BY timestamp, id) AS {letter}_ids,"
                f" list(epoch(timestamp)::BIGINT ORDER BY timestamp, id) AS {letter}_at FROM {table} GROUP BY ALL")
    return f"""
  SELECT p_ids[p] AS id, r_ids[r] AS repository_id FROM (
    WITH RECURSIVE lists AS (
      SELECT * FROM ({sides('nginx_logs', 'p')}) JOIN ({sides('nexus_logs', 'r')}) USING (ip_address, method, path)),
    steps AS (
      SELECT *, 1 AS p, 1 AS r FROM lists
      UNION ALL
      SELECT * REPLACE (
        CASE WHEN r_at[r] < p_at[p] - {seconds} THEN p ELSE p + 1 END AS p,
        CASE WHEN r_at[r] > p_at[p] + {seconds} THEN r ELSE r + 1 END AS r)
      FROM steps WHERE p <= len(p_at) AND r <= len(r_at))
    SELECT * FROM steps)
  WHERE p <= len(p_at) AND r <= len(r_at) AND abs(p_at[p] - r_at[r]) <= {seconds}"""


_IN_FLIGHT = f"""
  SELECT {_REPOSITORY} AS repository, unnest(range(
    epoch(timestamp)::BIGINT, (epoch_ms(timestamp) + greatest(processing_time_ms, 0)) // 1000 + 1)) AS second, id
  FROM nexus_logs WHERE {_REPOSITORY} IS NOT NULL AND processing_time_ms IS NOT NULL"""

_SESSIONS = """
  SELECT ip_address, session, min(timestamp) AS first_request, max(timestamp) AS last_request,
    count(*) AS requests, sum(response_size)::BIGINT AS bytes
  FROM (SELECT *, sum(begins) OVER (PARTITION BY ip_address ORDER BY timestamp)::BIGINT AS session
        FROM (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY ip_address ORDER BY timestamp, id)
                < INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS begins FROM nginx_logs))
  GROUP BY ALL"""


QUERIES: dict[str, str] = {
    # parsing
    "nginx_parse": _nginx("SELECT * FROM nginx_logs"),
    "nexus_parse": _nexus("SELECT * FROM nexus_logs"),
    "custom_service_parse": _custom("SELECT * FROM custom_service_logs"),
    "nginx_request_class": _nginx(
        "SELECT method, http_version, count(*) AS requests, count(DISTINCT path) AS paths"
        " FROM nginx_logs GROUP BY ALL"),
    "nexus_timestamp_shapes": STAMPS,
    "nginx_quarantine": _nginx(_quarantine("nginx", "nginx_all")),
    "nexus_quarantine": _nexus(_quarantine("nexus", "nexus_all")),
    "custom_service_quarantine": _custom(_quarantine("custom_service", "custom_all")),
    # storing and reading back
    "ingest_lines": _nginx(_STORED_NGINX),
    "ingest_text_folder": _nginx(_STORED_NGINX),
    "ingest_gzip_folder": _nginx(_STORED_NGINX),
    "ingest_tar_archives": _nginx(_STORED_NGINX),
    "ingest_stream": _nginx(_STORED_NGINX),
    "ingest_stream_gzip": _nginx(_STORED_NGINX),
    "ingest_zip_archives": _from_files(
        f"'access.log.' || {_FILE} || '.zip->' || CASE WHEN {_ODD} THEN 'ACCESS.LOG.1' ELSE 'logs/access.log' END"),
    "ingest_nested_archives": _from_files(
        f"'access.log.' || {_FILE} || '.tar->' || CASE WHEN {_ODD} THEN 'access.log.1.gz->access.log.1'"
        " ELSE 'old/access.log.tar.gz->access.log.zip->access.log' END"),
    "ingest_damaged_archives": _from_files(
        f"'access.log.' || {_FILE} || '.gz->access.log.' || {_FILE}", f"{_FILE} % 3 <> 0"),
    "damaged_archives_skipped": _skipped("('access.log.' || n || '.gz', 'Unreadable archive')", "n % 3 = 0"),
    # Of the members of one name the last counts, and a link stands for the first.
    "ingest_tar_links": _with(f"""
  SELECT * EXCLUDE (id, file_source), 'nginx:access.log.' || {_FILE} || '.tar.bz2->' || unnest(
    ['access.log', 'access.log.current', './access.log.1']) AS file_source FROM nginx_logs WHERE NOT {_ODD}""", NGINX),
    "tar_members_skipped": _skipped(
        "('access.log.' || n || '.tar.bz2->access.log.gone', 'Link without a file'),"
        " ('access.log.' || n || '.tar.bz2->../access.log', 'Unsafe path in archive'),"
        " ('access.log.' || n || '.tar.bz2->access.log.1', 'Replaced by a later member of the same name')"),
    **{key: _from_files(
        f"CASE {_FILE} % 3 WHEN 0 THEN 'ACCESS.Log.' || {_FILE} ELSE 'Other-' || {_FILE} || '.log' END", f"{_FILE} % 3 < 2")
       for key in ("ingest_linked_files", "ingest_mixed_case")},
    "ingest_hidden_folders": _from_files(f"'access.log.' || {_FILE}"),
    "ingest_broken_bytes": _from_files(f"'access.log.' || {_FILE}", path=_BROKEN.format("path"), raw_log=_BROKEN.format("raw_log")),
    "ingest_fresh": _nginx(_STORED_NGINX),
    "ingest_nexus": _nexus("SELECT * EXCLUDE (id, file_source) FROM nexus_logs"),
    "ingest_ids": _nginx("SELECT 2 * count(*) AS entries, 2 * count(*) AS ids, true AS ascending,"
                         " 2 * count(*) AS stamped FROM nginx_logs"),
    "ingest_append": _nginx(f"{_STORED_NGINX} UNION ALL {_STORED_NGINX}"),
    "ingest_custom_service": _custom("SELECT * EXCLUDE (id, file_source) FROM custom_service_logs"),
    "stored_preview": _nginx(
        f"SELECT {', '.join(c for c in NGINX_PREVIEW.split() if c not in ('id', 'file_source'))},"
        " strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM nginx_logs ORDER BY id DESC LIMIT 10"),
    "store_quick_statistics": _nginx(
        "SELECT 'nginx_logs' AS table_name, 2 * count(*) AS total_entries, count(DISTINCT CAST(timestamp AS DATE)) AS unique_days,"
        " min(timestamp) AS earliest_log, max(timestamp) AS latest_log, true AS ips_close FROM nginx_logs"),
    "store_ingest_history": _nginx(
        "SELECT 'batch' AS origin, range::BIGINT AS ingest, count(*) FILTER (reason IS NULL) AS entries,"
        " count(*) FILTER (reason IS NOT NULL) AS parse_errors, 0::BIGINT AS skipped, count(*) AS lines,"
        " count(*) FILTER (reason IS NULL)::DOUBLE / count(*)::DOUBLE AS success_rate FROM nginx_all, range(2) GROUP BY range"),
    "stored_quarantine": _nginx("SELECT 'nginx' AS format, raw_log AS raw_line, reason FROM nginx_all"
                                " WHERE reason IS NOT NULL"),
    "stored_time_range": _nginx(
        "SELECT timestamp, method, path, status_code, ip_address, user_agent FROM nginx_logs"
        f" WHERE timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"),
    # statistics of an ingest
    "ingest_stats_by_file": _both(
        "SELECT file_source, entries, parse_errors, lines,"
        f" entries::DOUBLE / lines::DOUBLE AS success_rate FROM ({_PER_FILE})"),
    "ingest_stats_total": _both(_TOTALS),
    "ingest_summary": _both(
        "SELECT *, 2.0::DOUBLE AS processing_time, lines / 2.0::DOUBLE AS lines_per_second,"
        f" entries / 2.0::DOUBLE AS entries_per_second FROM ({_TOTALS})"),
    "reject_reasons": _nginx(
        "SELECT 'rejected' AS outcome, reason, count(*) AS occurrences FROM nginx_all"
        " WHERE reason IS NOT NULL GROUP BY ALL"),
    # named queries
    "nginx_preview": _nginx(_preview(NGINX_PREVIEW, "nginx_logs")),
    "nexus_preview": _nexus(_preview(NEXUS_PREVIEW, "nexus_logs")),
    "table_sample_by_id": _nexus("SELECT * FROM nexus_logs ORDER BY id DESC LIMIT 10"),
    "table_sample_by_created_at": _nginx(
        "SELECT *, date_trunc('day', timestamp)::TIMESTAMP AS created_at FROM nginx_logs"
        " ORDER BY created_at DESC, id DESC LIMIT 10"),
    "nginx_top_paths": _nginx(
        "SELECT path, count(*) AS hits FROM nginx_logs GROUP BY path ORDER BY hits DESC, path LIMIT 10"),
    "nginx_status_distribution": _nginx(
        "SELECT status_code, count(*) AS count FROM nginx_logs GROUP BY status_code"),
    "nginx_method_distribution": _nginx(
        "SELECT method, count(*) AS count FROM nginx_logs GROUP BY method"),
    **{key: _nginx(
        "SELECT method, status_class, day, grouping_id(method, status_class, day)::INTEGER AS level, count(*) AS requests,"
        " sum(response_size)::BIGINT AS bytes FROM (SELECT *, CAST(timestamp AS DATE) AS day,"
        " CASE WHEN status_code BETWEEN 200 AND 299 THEN 'success' WHEN status_code BETWEEN 300 AND 399 THEN 'redirect'"
        " WHEN status_code BETWEEN 400 AND 499 THEN 'client-error' WHEN status_code >= 500 THEN 'server-error'"
        f" ELSE 'unknown' END AS status_class FROM nginx_logs) GROUP BY {sets}")
       for key, sets in (("nginx_traffic_cube", "CUBE (method, status_class, day)"),
                         ("nginx_traffic_sets", "GROUPING SETS ((method, status_class), (day), ())"))},
    "nginx_top_clients": _nginx(
        "SELECT ip_address, count(*) AS requests FROM nginx_logs GROUP BY ip_address"
        " ORDER BY requests DESC, ip_address LIMIT 10"),
    "nginx_hits_by_method_and_path": _nginx(
        "SELECT method, path, count(*) AS hits FROM nginx_logs WHERE status_code = 200 GROUP BY ALL"),
    "nginx_size_by_method_and_status": _nginx(
        "SELECT method, status_code, count(*) AS count, avg(response_size) AS avg_bytes"
        " FROM nginx_logs WHERE status_code >= 200 GROUP BY ALL"),
    "nginx_size_range_by_status": _nginx(
        "SELECT status_code, count(*) AS count, min(response_size) AS min_bytes,"
        " max(response_size) AS max_bytes FROM nginx_logs GROUP BY ALL"),
    "nginx_time_range": _nginx(
        "SELECT timestamp, method, path, status_code, ip_address, user_agent FROM nginx_logs"
        f" WHERE timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
        " ORDER BY timestamp DESC, id DESC LIMIT 100"),
    "nexus_time_range": _nexus(
        f"SELECT timestamp, remote_user AS username, method, path, {_REPOSITORY} AS repository,"
        f" {_ACTION} AS action FROM nexus_logs"
        f" WHERE timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
        " ORDER BY timestamp DESC, id DESC LIMIT 100"),
    "nginx_recent_errors": _nginx(
        "SELECT * FROM nginx_logs WHERE status_code >= 400"
        f" AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY"),
    "nexus_top_repositories": _nexus(
        f"SELECT {_REPOSITORY} AS repository, count(*) AS activity_count FROM nexus_logs"
        f" WHERE {_REPOSITORY} IS NOT NULL GROUP BY 1 ORDER BY activity_count DESC, 1 LIMIT 10"),
    "nexus_user_activity": _nexus(
        "SELECT remote_user AS username, count(*) AS activity_count FROM nexus_logs"
        " WHERE remote_user NOT IN ('', '-') GROUP BY 1 ORDER BY activity_count DESC, 1 LIMIT 10"),
    "nexus_action_distribution": _nexus(
        f"SELECT {_ACTION} AS action, count(*) AS count FROM nexus_logs GROUP BY 1"),
    "custom_service_failures": _custom(
        "SELECT action, count(*) AS error_count FROM custom_service_logs WHERE level = 'ERROR'"
        " GROUP BY action ORDER BY error_count DESC, action LIMIT 100"),
    "table_statistics": _both(f"{_statistics('nginx_logs')} UNION ALL {_statistics('nexus_logs')}"),
    "table_row_counts": _both(
        "SELECT coalesce(t, 'total') AS table_name, sum(n)::BIGINT AS row_count FROM"
        " (SELECT 'nginx_logs' AS t, count(*) AS n FROM nginx_logs"
        " UNION ALL SELECT 'nexus_logs', count(*) FROM nexus_logs) GROUP BY ROLLUP (t)"),
    "table_profile": _both(
        _profile("nginx_logs", schemas.NGINX_LOGS, [("auth_user", "string"), ("tz_offset", "string")])
        + " UNION ALL "
        + _profile("nexus_logs", schemas.NEXUS_LOGS, [("tz_offset", "string")])),
    # both logs
    "all_logs": _both(
        "SELECT *, 'nginx_logs' AS log_type FROM nginx_logs"
        " UNION ALL BY NAME SELECT *, 'nexus_logs' AS log_type FROM nexus_logs"),
    "counts_by_source": _both(
        "SELECT 'nginx' AS source, count(*) AS count FROM nginx_logs"
        " UNION ALL SELECT 'nexus', count(*) FROM nexus_logs"),
    "counts_side_by_side": _both(
        "SELECT (SELECT count(*) FROM nginx_logs) AS nginx_count,"
        " (SELECT count(*) FROM nexus_logs) AS nexus_count"),
    "correlated_requests": _both(
        "SELECT n.ip_address, n.method, n.path, n.timestamp, n.nginx_requests,"
        " count(x.id) AS nexus_requests FROM (SELECT ip_address, method, path, timestamp,"
        " count(*) AS nginx_requests FROM nginx_logs GROUP BY ALL) n"
        f" LEFT JOIN nexus_logs x ON {_near(5)} GROUP BY ALL"),
    "requests_reaching_repository": _both(
        f"SELECT n.* FROM nginx_logs n WHERE EXISTS (SELECT 1 FROM nexus_logs x WHERE {_near(5)})"),
    "requests_missing_in_repository": _both(
        f"SELECT n.* FROM nginx_logs n WHERE NOT EXISTS (SELECT 1 FROM nexus_logs x WHERE {_near(5)})"),
    "requests_as_of_repository": _both(
        "SELECT n.*, x.id AS repository_id, x.timestamp AS repository_timestamp,"
        " epoch_ms(n.timestamp) - epoch_ms(x.timestamp) AS age_ms FROM nginx_logs n ASOF LEFT JOIN"
        " (SELECT ip_address, method, path, timestamp, max(id) AS id FROM nexus_logs GROUP BY ALL) x"
        " ON n.ip_address = x.ip_address AND n.method = x.method AND n.path = x.path AND n.timestamp >= x.timestamp"),
    "requests_as_of_clients": _both(
        "SELECT n.id, CASE WHEN n.timestamp - x.timestamp <= INTERVAL 3600 SECOND THEN x.id END AS repository_id"
        " FROM nginx_logs n ASOF LEFT JOIN"
        " (SELECT ip_address, timestamp, max(id) AS id FROM nexus_logs GROUP BY ALL) x"
        " ON n.ip_address = x.ip_address AND n.timestamp >= x.timestamp"),
    "request_pairs": _both(_paired(5)),
    "request_pairs_within_an_hour": _both(_paired(3600)),
    "repository_requests_in_flight": _nexus(
        "SELECT repository, make_timestamp(second * 1000000) AS second, count(*) AS requests"
        f" FROM ({_IN_FLIGHT}) GROUP BY ALL"),
    "repository_peak_in_flight": _nexus(
        "SELECT repository, max(requests) AS peak, make_timestamp(arg_max(second, (requests, -second)) * 1000000) AS first_reached"
        f" FROM (SELECT repository, second, count(*) AS requests FROM ({_IN_FLIGHT}) GROUP BY ALL) GROUP BY ALL"),
    "client_sessions": _nginx(_SESSIONS),
    # streams
    "stream_window_counts": _nginx(
        "SELECT status_code, length, step, make_timestamp((epoch(timestamp)::BIGINT // step - k) * step * 1000000) AS window_start,"
        " count(*) AS requests, true AS closed FROM (SELECT *, unnest(range(length // step)) AS k FROM nginx_logs,"
        " (VALUES (3600, 3600), (3600, 900)) w(length, step)) GROUP BY ALL"),
    "stream_client_sessions": _nginx(f"SELECT * EXCLUDE (session) FROM ({_SESSIONS})"),
    "stream_requests_missing": _both(
        f"SELECT n.* EXCLUDE (id, file_source) FROM nginx_logs n WHERE NOT EXISTS (SELECT 1 FROM nexus_logs x WHERE {_near(5)})"),
    # presentation
    "display_requests": _nginx(
        "SELECT id, CASE WHEN status_code BETWEEN 200 AND 299 THEN 'success'"
        " WHEN status_code BETWEEN 300 AND 399 THEN 'redirect'"
        " WHEN status_code BETWEEN 400 AND 499 THEN 'client-error'"
        " WHEN status_code >= 500 THEN 'server-error' ELSE 'unknown' END AS status_class,"
        f" {_SIZE} AS size, {_CUT.format('path', 50)} AS path, {_CUT.format('user_agent', 30)} AS user_agent,"
        " coalesce(CAST(response_size AS VARCHAR), '') AS size_cell, coalesce(referer, '') AS referer_cell"
        " FROM nginx_logs"),
}
