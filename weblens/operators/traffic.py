"""Named queries over one log table.

Every top-k adds a tie-break, so a limit always gives the same rows. Aggregates combine on
the map side first, which keeps a path or client holding much of the traffic harmless.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from weblens.functions import action_of, repository_of, status_class


def counts(logs: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    """Rows per combination of keys, the most frequent first."""
    return logs.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.desc(name), *keys)


def top_paths(logs: DataFrame, limit: int = 10) -> DataFrame:
    return counts(logs, "path", name="hits").limit(limit)


def status_distribution(logs: DataFrame) -> DataFrame:
    return counts(logs, "status_code")


def method_distribution(logs: DataFrame) -> DataFrame:
    return counts(logs, "method")


def top_clients(logs: DataFrame, limit: int = 10) -> DataFrame:
    return counts(logs, "ip_address", name="requests").limit(limit)


def hits_by_method_and_path(logs: DataFrame, status: int = 200) -> DataFrame:
    return counts(logs.where(F.col("status_code") == status), "method", "path", name="hits")


def size_by_method_and_status(logs: DataFrame, at_least: int = 200) -> DataFrame:
    return (
        logs.where(F.col("status_code") >= at_least)
        .groupBy("method", "status_code")
        .agg(F.count("*").alias("count"), F.avg("response_size").alias("avg_bytes"))
        .orderBy(F.desc("count"), "method", "status_code")
    )


def size_range_by_status(logs: DataFrame) -> DataFrame:
    return (
        logs.groupBy("status_code")
        .agg(
            F.count("*").alias("count"),
            F.min("response_size").alias("min_bytes"),
            F.max("response_size").alias("max_bytes"),
        )
        .orderBy("status_code")
    )


def between(logs: DataFrame, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
    """Rows of a time range, both ends included.

    A stored table is partitioned by day (`log_date`); there the range prunes partitions too.
    """
    for bound, op in ((start, Column.__ge__), (end, Column.__le__)):
        if bound is None:
            continue
        # As text: a datetime literal would be taken for local time.
        logs = logs.where(op(F.col("timestamp"), F.lit(str(bound)).cast("timestamp_ntz")))
        if "log_date" in logs.columns:
            logs = logs.where(op(F.col("log_date"), F.lit(bound.date())))
    return logs


def _latest(logs: DataFrame, columns: list[Column | str], limit: int) -> DataFrame:
    newest_first = [F.desc("timestamp"), F.desc("id")]
    return logs.orderBy(*newest_first).limit(limit).select(*columns)


def nginx_time_range(
    logs: DataFrame, start: dt.datetime, end: dt.datetime, limit: int = 100
) -> DataFrame:
    """The newest requests of a time range."""
    columns = ["timestamp", "method", "path", "status_code", "ip_address", "user_agent"]
    return _latest(between(logs, start, end), columns, limit)


def nexus_time_range(
    logs: DataFrame, start: dt.datetime, end: dt.datetime, limit: int = 100
) -> DataFrame:
    """The newest repository requests of a time range."""
    columns = [
        "timestamp", F.col("remote_user").alias("username"), "method", "path",
        repository_of(F.col("path")).alias("repository"),
        action_of(F.col("method")).alias("action"),
    ]
    return _latest(between(logs, start, end), columns, limit)


def recent_errors(logs: DataFrame, now: dt.datetime, days: int = 1) -> DataFrame:
    """Requests answered with 400 or above since `days` before `now`."""
    since = now - dt.timedelta(days=days)
    return between(logs.where(F.col("status_code") >= 400), since, None)


def top_repositories(logs: DataFrame, limit: int = 10) -> DataFrame:
    repositories = logs.select(repository_of(F.col("path")).alias("repository"))
    named = repositories.where(F.col("repository").isNotNull())
    return counts(named, "repository", name="activity_count").limit(limit)


def user_activity(logs: DataFrame, limit: int = 10) -> DataFrame:
    """Requests per known user; anonymous requests carry a dash."""
    users = logs.select(F.col("remote_user").alias("username"))
    known = users.where(~F.col("username").isin("", "-"))
    return counts(known, "username", name="activity_count").limit(limit)


def action_distribution(logs: DataFrame) -> DataFrame:
    return counts(logs.select(action_of(F.col("method")).alias("action")), "action")


def failures_by_action(logs: DataFrame, limit: int = 100) -> DataFrame:
    """Error lines per action of a custom-service log."""
    errors = logs.where(F.col("level") == "ERROR")
    return counts(errors, "action", name="error_count").limit(limit)


def traffic_cube(logs: DataFrame, sets: list[list[str]] | None = None) -> DataFrame:
    """Requests and bytes by method, status class and day, for all combinations of these or the given `sets`.

    `level` is the grouping id, a bit for each of the three that is summed over; it tells such a NULL
    from one in the log. Rows are combined to one per method, class and day first, so only those are
    copied for the combinations, all of them in one pass.
    """
    axes = ["method", "status_class", "day"]
    reduced = logs.groupBy(
        "method", status_class(F.col("status_code")).alias("status_class"), F.to_date("timestamp").alias("day"),
    ).agg(F.count("*").alias("n"), F.sum("response_size").alias("size"))
    grouped = reduced.cube(*axes) if sets is None else reduced.groupingSets([[F.col(c) for c in s] for s in sets], *axes)
    return grouped.agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("requests"), F.sum("size").alias("bytes"))
