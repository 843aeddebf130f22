"""SELECT texts run through the guarded SQL entry, and unchanged by DuckDB over the same tables."""

from __future__ import annotations

from oracles.duckdb_sql import NOW, _both

# key: (text, named or positional values, the text with the values written out)
TEXTS: dict[str, tuple[str, dict | list | None]] = {
    "sql_count_nginx": ("SELECT COUNT(*) AS total_nginx_logs FROM nginx_logs", None),
    "sql_count_nexus": ("SELECT COUNT(*) AS total_nexus_logs FROM nexus_logs", None),
    "sql_method_distribution": (
        "SELECT method, COUNT(*) AS count FROM nginx_logs GROUP BY method ORDER BY count DESC;", None),
    "sql_status_distribution": (
        "SELECT status_code, COUNT(*) AS count FROM nginx_logs GROUP BY status_code ORDER BY count DESC",
        None),
    "sql_top_clients": (
        "SELECT ip_address, COUNT(*) AS requests FROM nginx_logs GROUP BY ip_address"
        " ORDER BY requests DESC, ip_address LIMIT 10", None),
    "sql_size_by_method_and_status": (
        "SELECT method, status_code, COUNT(*) AS count, AVG(response_size) AS avg_bytes FROM nginx_logs"
        " WHERE status_code >= 200 GROUP BY method, status_code ORDER BY count DESC", None),
    "sql_size_range_by_status": (
        "SELECT status_code, COUNT(*) AS count, MIN(response_size) AS min_bytes,"
        " MAX(response_size) AS max_bytes FROM nginx_logs GROUP BY status_code ORDER BY status_code", None),
    "sql_errors_per_day": (
        "SELECT CAST(timestamp AS DATE) AS day, COUNT(*) AS errors FROM nginx_logs"
        " WHERE status_code >= 400 GROUP BY CAST(timestamp AS DATE)", None),
    "sql_union_all": (
        "SELECT 'nginx' AS source, COUNT(*) AS count FROM nginx_logs"
        " UNION ALL SELECT 'nexus' AS source, COUNT(*) AS count FROM nexus_logs", None),
    "sql_union_distinct": (
        "SELECT ip_address FROM nginx_logs UNION SELECT ip_address FROM nexus_logs", None),
    "sql_intersect": (
        "SELECT path FROM nginx_logs INTERSECT SELECT path FROM nexus_logs", None),
    "sql_except": ("SELECT path FROM nexus_logs EXCEPT SELECT path FROM nginx_logs", None),
    "sql_side_by_side": (
        "SELECT (SELECT COUNT(*) FROM nginx_logs) AS nginx_count,"
        " (SELECT COUNT(*) FROM nexus_logs) AS nexus_count", None),
    "sql_join_clients": (
        "SELECT n.ip_address, n.requests, x.transfers FROM"
        " (SELECT ip_address, COUNT(*) AS requests FROM nginx_logs GROUP BY ip_address) n,"
        " (SELECT ip_address, COUNT(*) AS transfers FROM nexus_logs GROUP BY ip_address) x"
        " WHERE n.ip_address = x.ip_address", None),
    "sql_anti_join": (
        "SELECT COUNT(*) AS unseen FROM nginx_logs n WHERE NOT EXISTS"
        " (SELECT 1 FROM nexus_logs x WHERE x.path = n.path)", None),
    "sql_window": (
        "SELECT ip_address, day, requests, CAST(SUM(requests) OVER (PARTITION BY ip_address ORDER BY day)"
        " AS BIGINT) AS so_far FROM (SELECT ip_address, CAST(timestamp AS DATE) AS day,"
        " COUNT(*) AS requests FROM nginx_logs GROUP BY ip_address, CAST(timestamp AS DATE)) t", None),
    "sql_predicate": (
        "SELECT ip_address, method, status_code, COUNT(*) AS requests FROM nginx_logs"
        " WHERE status_code = 200 GROUP BY ip_address, method, status_code", None),
    "sql_empty": ("SELECT * FROM nginx_logs WHERE status_code > 599", None),
    "sql_literal": ("SELECT 3 AS query_id, COUNT(*) AS count FROM nginx_logs", None),
    "sql_named_values": (
        "SELECT method, COUNT(*) AS count FROM nginx_logs WHERE status_code >= :least"
        " AND timestamp >= CAST(:now AS TIMESTAMP) - INTERVAL 1 DAY GROUP BY method",
        {"least": 400, "now": NOW}),
    "sql_positional_values": (
        "SELECT method, COUNT(*) AS count FROM nexus_logs WHERE status_code >= ? AND method <> ?"
        " GROUP BY method", [400, "HEAD"]),
    "sql_created_like_names": (
        "SELECT COUNT(*) AS created_count FROM nexus_logs WHERE method = 'DELETE'", None),
}


def _literal(value: object) -> str:
    return str(value) if isinstance(value, int) else f"'{value}'"


def _written_out(text: str, values: dict | list | None) -> str:
    if isinstance(values, dict):
        for name, value in values.items():
            text = text.replace(f":{name}", _literal(value))
    for value in values if isinstance(values, list) else []:
        text = text.replace("?", _literal(value), 1)
    return text.rstrip(";")


QUERIES = {key: _both(_written_out(*entry)) for key, entry in TEXTS.items()}

CAPPED = "SELECT id, path FROM nginx_logs ORDER BY id"
QUERIES["sql_row_cap"] = _both(f"{CAPPED} LIMIT 1000")
