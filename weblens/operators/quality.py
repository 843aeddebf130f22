"""Ingest statistics over parsed lines (good and rejected; skipped sources are not lines)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weblens.operators.parse import PARSED, REJECTED, SKIPPED


def _is(outcome: str) -> Column:
    return F.col("outcome") == outcome


def success_rate(entries: Column, lines: Column) -> Column:
    """Share of lines that were parsed; 1.0 where there was no line."""
    return F.when(lines == 0, F.lit(1.0)).otherwise(entries / lines)


def _with_rate(stats: DataFrame) -> DataFrame:
    lines = F.col("entries") + F.col("parse_errors")
    return stats.withColumn("lines", lines).withColumn(
        "success_rate", success_rate(F.col("entries"), F.col("lines"))
    )


def stats_by_file(parsed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Lines, entries, errors and success rate per file.

    Files are told apart by full path where the input carries one, as two folders may hold
    files of the same name. A file without any line shows up only if it is among `files`
    (`file_path`, `file_source`; see `sources.discover.list_plain`).
    """
    keys = [k for k in ("file_path", "file_source") if k in parsed.columns]
    counted = parsed.where(~_is(SKIPPED)).groupBy(*keys).agg(
        F.count_if(_is(PARSED)).alias("entries"),
        F.count_if(_is(REJECTED)).alias("parse_errors"),
    )
    if files is not None:
        seen = files.select(*keys, F.lit(0).alias("entries"), F.lit(0).alias("parse_errors"))
        counted = counted.unionByName(seen).groupBy(*keys).agg(
            F.sum("entries").alias("entries"), F.sum("parse_errors").alias("parse_errors")
        )
    return _with_rate(counted)


def stats_by_format(
    parsed: dict[str, DataFrame], files: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Files, lines, entries, errors and success rate per format, and the total (`format` NULL).

    Each format is counted per file first, so the roll-up runs over one row per file. `files`
    may name all files of a format, as for `stats_by_file`. A format without lines is a row of
    zeros.
    """
    per_file = [
        stats_by_file(frame, (files or {}).get(name))
        .select(F.lit(name).alias("format"), "entries", "parse_errors")
        for name, frame in parsed.items()
    ]
    # A row of no file per format: one without files or lines has totals too, of zero.
    none = [
        frame.sparkSession.range(1).select(
            F.lit(name).alias("format"), F.lit(0).alias("entries"), F.lit(0).alias("parse_errors"), F.lit(0).alias("is_file"))
        for name, frame in parsed.items()
    ]
    counted = reduce(DataFrame.unionByName, [*(f.withColumn("is_file", F.lit(1)) for f in per_file), *none])
    totals = counted.rollup("format").agg(
        F.sum("is_file").alias("files"),
        F.sum("entries").alias("entries"),
        F.sum("parse_errors").alias("parse_errors"),
    )
    return _with_rate(totals)


def reject_reasons(parsed: DataFrame) -> DataFrame:
    """How often each reason occurs among the rejected lines and skipped sources."""
    return (
        parsed.where(F.col("reason").isNotNull())
        .groupBy("outcome", "reason").agg(F.count("*").alias("occurrences"))
    )


def processing_summary(stats: DataFrame, seconds: float) -> DataFrame:
    """Statistics per format with the throughput of a run that took `seconds`."""
    def rate(name: str) -> Column:
        return F.when(F.lit(seconds) > 0, F.col(name) / F.lit(seconds))

    return stats.select(
        "*",
        F.lit(float(seconds)).alias("processing_time"),
        rate("lines").alias("lines_per_second"),
        rate("entries").alias("entries_per_second"),
    )
