"""Read-only SQL over the log views, with a cap on the rows that reach the driver."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

DEFAULT_ROWS = 100
MAX_ROWS = 1000

# Classes that no analysed plan may hold: a program run over the rows, any JVM method called.
_FORBIDDEN = {"ScriptTransformation", "CallMethodViaReflection", "TryReflect"}
# The setting below belongs to the session, which threads may share.
_reading_files = threading.Lock()


def _classes(node: Any) -> Iterator[str]:
    """Short names of all classes in a plan given as JSON; texts in it are not looked at."""
    if isinstance(node, dict):
        if isinstance(name := node.get("class"), str):
            yield name.rpartition(".")[2]
        for value in node.values():
            yield from _classes(value)
    elif isinstance(node, list):
        for value in node:
            yield from _classes(value)


class QueryRefused(ValueError):
    """The text is not a plain SELECT."""


def query(
    spark: SparkSession, text: str, args: Mapping[str, Any] | Sequence[Any] | None = None
) -> DataFrame:
    """A SELECT as a DataFrame, not run yet. `args` are named (`:x`) or positional (`?`) values.

    Spark takes one statement per call, so text after a `;` is an error. What Spark allows
    inside a SELECT and a log query must not do is refused: reading files by path
    (`text.`/etc/passwd``), running a program (TRANSFORM ... USING), calling JVM methods.
    """
    if not (text or "").strip()[:6].upper() == "SELECT":
        raise QueryRefused("Only SELECT queries are allowed for security")
    key = "spark.sql.runSQLOnFiles"
    with _reading_files:
        before = spark.conf.get(key, None)
        spark.conf.set(key, "false")
        try:
            frame = spark.sql(text, args=args) if args else spark.sql(text)
        finally:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    plan = json.loads(frame._jdf.queryExecution().analyzed().toJSON())
    if not _FORBIDDEN.isdisjoint(_classes(plan)):
        raise QueryRefused("The query runs a program or calls JVM code")
    return frame


def run_sql(
    spark: SparkSession, text: str, limit: int | None = DEFAULT_ROWS,
    args: Mapping[str, Any] | Sequence[Any] | None = None, most: int = MAX_ROWS,
) -> DataFrame:
    """A SELECT cut to `limit` rows, `most` at most. A smaller LIMIT in the text stays in force."""
    return query(spark, text, args).limit(min(limit or DEFAULT_ROWS, most))


def execute(
    spark: SparkSession, text: str, limit: int | None = DEFAULT_ROWS,
    args: Mapping[str, Any] | Sequence[Any] | None = None, most: int = MAX_ROWS,
) -> dict[str, Any]:
    """Run a SELECT; its rows with column names, row count, seconds taken and the text.

    `truncated` tells whether there are more rows than the cap let through. No rows, no columns:
    the names are those of the first row.
    """
    began = time.monotonic()
    cap = min(limit or DEFAULT_ROWS, most)
    found = query(spark, text, args).limit(cap + 1).collect()
    rows = [row.asDict() for row in found[:cap]]
    return {
        "results": rows,
        "columns": list(rows[0]) if rows else [],
        "row_count": len(rows),
        "truncated": len(found) > cap,
        "execution_time": round(time.monotonic() - began, 4),
        "query_text": text,
    }
