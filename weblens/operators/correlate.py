"""Both logs together: stacking, counting side by side, matching proxy and repository requests.

Two requests correspond when client, method and path are equal and their times differ by at
most `seconds`. Times carry whole seconds, and that is what keeps a busy key cheap: rows are
combined per key and second (or key and time bucket) before they are shuffled, and the time
bucket is part of the shuffle key, so no task receives the whole history of one key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from weblens.functions import offset_seconds

KEYS = ("ip_address", "method", "path")


def all_logs(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables stacked; a column a table lacks is NULL there, `log_type` names the table."""
    tagged = (logs.withColumn("log_type", F.lit(name)) for name, logs in tables.items())
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def counts_by_source(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: its name and its number of rows."""
    counted = (
        logs.agg(F.lit(name).alias("source"), F.count("*").alias("count"))
        for name, logs in tables.items()
    )
    return reduce(DataFrame.unionByName, counted)


def counts_side_by_side(nginx: DataFrame, nexus: DataFrame) -> DataFrame:
    """One row: the number of rows of both tables."""
    nginx_count = nginx.agg(F.count("*").alias("nginx_count"))
    nexus_count = nexus.agg(F.count("*").alias("nexus_count"))
    return nginx_count.select("nginx_count", nexus_count.scalar().alias("nexus_count"))


def _epoch(logs: DataFrame, normalise: bool) -> Column:
    """Seconds of the wall clock, or of UTC where `normalise` asks for it and a zone is known."""
    time = F.col("timestamp")
    days = F.unix_date(F.to_date(time)).cast("long")
    wall = days * 86400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    if normalise and "tz_offset" in logs.columns:
        return wall - offset_seconds(F.col("tz_offset"))
    return wall


def _check(seconds: int) -> int:
    if seconds < 0:
        raise ValueError("seconds must not be negative")
    return seconds


def correlated_requests(
    nginx: DataFrame, nexus: DataFrame, seconds: int = 5, normalise: bool = False
) -> DataFrame:
    """Per client, method, path and second of the proxy log: how many requests the proxy saw,
    and how many the repository log holds within `seconds` of it.

    Both logs are reduced together to one row per key and second, then counted in a sliding
    window. A window partition is one key in one stretch of time, so its size is bounded by the
    length of the stretch. Repository rows near a border are handed to both neighbours.
    """
    _check(seconds)
    stretch = max(2 * seconds + 1, 600)

    def part(second: Column) -> Column:
        return F.floor(second / stretch)

    second = F.col("second")
    near = F.array_distinct(F.array(part(second - seconds), part(second + seconds)))
    proxy = nginx.select(*KEYS, _epoch(nginx, normalise).alias("second")).select(
        "*", part(second).alias("part"), F.lit(1).alias("by_proxy"), F.lit(0).alias("by_repository")
    )
    repository = nexus.select(*KEYS, _epoch(nexus, normalise).alias("second")).select(
        "*", F.explode(near).alias("part"), F.lit(0).alias("by_proxy"), F.lit(1).alias("by_repository")
    )
    per_second = proxy.unionByName(repository).groupBy(*KEYS, "part", "second").agg(
        F.sum("by_proxy").alias("nginx_requests"), F.sum("by_repository").alias("seen")
    )
    around = (
        Window.partitionBy(*KEYS, "part").orderBy("second").rangeBetween(-seconds, seconds)
    )
    return (
        per_second.withColumn("nexus_requests", F.sum("seen").over(around))
        .where(F.col("nginx_requests") > 0)
        .select(
            *KEYS,
            F.timestamp_add("SECOND", second, F.lit("1970-01-01").cast("timestamp_ntz"))
            .alias("timestamp"),
            "nginx_requests", "nexus_requests",
        )
    )


def _reach(nexus: DataFrame, seconds: int, normalise: bool, keys: Sequence[str]) -> DataFrame:
    """One row per key and time bucket saying which seconds of the bucket the log covers.

    With buckets `max(seconds, 1)` long, any request of the same bucket is near enough; of the
    bucket before only the latest matters and of the one after only the earliest.
    """
    width = max(seconds, 1)
    spread = nexus.select(
        *keys, _epoch(nexus, normalise).alias("second"),
        F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("shift"),
    )
    return spread.groupBy(*keys, (F.floor(F.col("second") / width) + F.col("shift")).alias("bucket")).agg(
        F.bool_or(F.col("shift") == 0).alias("same"),
        F.max(F.when(F.col("shift") == 1, F.col("second"))).alias("latest_before"),
        F.min(F.when(F.col("shift") == -1, F.col("second"))).alias("earliest_after"),
    )


def _match(
    nginx: DataFrame, nexus: DataFrame, seconds: int, normalise: bool, how: str, keys: Sequence[str] = KEYS
) -> DataFrame:
    width = max(_check(seconds), 1)
    reach = _reach(nexus, seconds, normalise, keys).alias("r")
    second = _epoch(nginx, normalise)
    proxy = nginx.select("*", second.alias("_second"), F.floor(second / width).alias("_bucket")).alias("p")
    same_key = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in keys]
    near = (
        F.col("r.same")
        | (F.col("p._second") - F.col("r.latest_before") <= seconds)
        | (F.col("r.earliest_after") - F.col("p._second") <= seconds)
    )
    on = reduce(Column.__and__, [*same_key, F.col("p._bucket") == F.col("r.bucket"), near])
    return proxy.join(reach, on, how).drop("_second", "_bucket")


def requests_reaching_repository(
    nginx: DataFrame, nexus: DataFrame, seconds: int = 5, normalise: bool = False
) -> DataFrame:
    """Proxy requests the repository log holds a counterpart of.

    A plain equi-join on key and time bucket against one row per bucket: no request is ever
    paired with many, and adaptive execution may split a bucket that is crowded all the same.
    """
    return _match(nginx, nexus, seconds, normalise, "left_semi")


def requests_missing_in_repository(
    nginx: DataFrame, nexus: DataFrame, seconds: int = 5, normalise: bool = False, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Proxy requests that never reached the repository."""
    return _match(nginx, nexus, seconds, normalise, "left_anti", keys)
