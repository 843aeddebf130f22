"""Columns derived from the HTTP request."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weblens.functions.display import truncate_text

# Labels of requests that are not HTTP, and the stand-ins stored with them.
SSH_ATTEMPT = "SSH-ATTEMPT"
JSON_RPC = "JSON-RPC"
BINARY_DATA = "BINARY-DATA"
MALFORMED = "MALFORMED"
BINARY_PATH = "[BINARY]"
NON_HTTP = "NON-HTTP"
KEPT_CHARS = 50


def classify_request(
    request: Column, verb: Column, target: Column, version: Column
) -> tuple[Column, Column, Column]:
    """(method, path, http_version) of a quoted request.

    `verb`, `target` and `version` are the three parts of an HTTP request, `version` being
    empty when the text is something else. What else it is, the text decides, first hit wins:
    an SSH banner, JSON (or text naming a method), control or non-ASCII characters, the rest.
    """
    is_http = version != ""
    kind = (
        F.when(F.startswith(request, F.lit("SSH-")), SSH_ATTEMPT)
        .when(F.startswith(request, F.lit("{")) | F.contains(request, F.lit("method")), JSON_RPC)
        .when(request.rlike(r"[^\x20-\x7e]"), BINARY_DATA)
        .otherwise(MALFORMED)
    )
    stored = (
        F.when(kind == SSH_ATTEMPT, request)
        .when(kind == BINARY_DATA, BINARY_PATH)
        .otherwise(truncate_text(request, KEPT_CHARS))
    )
    return (
        F.when(is_http, verb).otherwise(kind),
        F.when(is_http, target).otherwise(stored),
        F.when(is_http, version).otherwise(NON_HTTP),
    )


def repository_of(path: Column) -> Column:
    """Repository name of a repository-manager path, NULL for other paths."""
    return F.nullif(F.regexp_extract(path, r"^/repository/([^/]+)", 1), F.lit(""))


def action_of(method: Column) -> Column:
    """What a request does to a repository."""
    return (
        F.when(method.isin("GET", "HEAD"), "download")
        .when(method.isin("PUT", "POST"), "upload")
        .when(method == "DELETE", "delete")
        .otherwise("other")
    )
