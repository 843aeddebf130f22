"""Lines to typed rows, with a reason for every line that is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weblens.formats import LogFormat

PARSED, REJECTED, SKIPPED = "parsed", "rejected", "skipped"

# A line holds no line feed, so it can separate the captured groups.
_SEPARATOR = "\n"


def _captured(line: Column, fmt: LogFormat) -> Column:
    """All capture groups of the line as one array, from a single pass of the pattern.

    The matched line is replaced by its groups behind separators, then split. A line that does
    not match stays as it is and gives an array of one element. `regexp_extract` would run the
    pattern again for every group.
    """
    marks = "".join(f"{_SEPARATOR}${i}" for i in range(1, len(fmt.groups) + 1))
    spread = F.regexp_replace(line, f"(?s){fmt.pattern}.*", marks)
    return F.when(~F.contains(line, F.lit(_SEPARATOR)), F.split(spread, _SEPARATOR))


def parse(lines: DataFrame, fmt: LogFormat, line: str = "value") -> DataFrame:
    """One row per non-blank line: the format's columns, `raw_log`, `reason` and `outcome`.

    `reason` is NULL for a good line. Other columns of the input are kept. If the input has a
    column `problem` (see `schemas.RAW_LINES`), rows with a problem come out as skipped.
    """
    kept = [c for c in lines.columns if c not in (line, "problem")]
    problem = F.col("problem") if "problem" in lines.columns else F.lit(None).cast("string")

    # explode() of a one-element array keeps filters on parsed columns above the pattern match.
    # Pushed below it, they would make every line be matched twice.
    matched = (
        lines.where(F.col(line).rlike(r"\S") | problem.isNotNull())
        .select(*kept, F.col(line).alias("raw_log"), problem.alias("problem"),
                F.explode(F.array(_captured(F.col(line), fmt))).alias("groups"))
    )
    groups = {name: F.get("groups", F.lit(i)) for i, name in enumerate(fmt.groups, start=1)}
    columns = fmt.columns(groups)
    is_match = F.coalesce(F.size("groups") == len(fmt.groups) + 1, F.lit(False))

    reason = F.when(F.col("problem").isNotNull(), F.col("problem")).when(~is_match, fmt.no_match)
    for name, message in fmt.checks:
        reason = reason.when(columns[name].isNull(), message)
    outcome = (
        F.when(F.col("problem").isNotNull(), SKIPPED)
        .when(reason.isNotNull(), REJECTED)
        .otherwise(PARSED)
    )
    return matched.select(
        *kept,
        *(column.alias(name) for name, column in columns.items()),
        "raw_log",
        reason.alias("reason"),
        outcome.alias("outcome"),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    """The good rows."""
    return parsed.where(F.col("reason").isNull()).drop("reason", "outcome")


def quarantine(parsed: DataFrame, fmt: LogFormat) -> DataFrame:
    """The rejected lines and skipped sources with their reason."""
    known = set(parsed.columns)

    def optional(name: str, kind: str) -> Column:
        return (F.col(name) if name in known else F.lit(None)).cast(kind)

    return parsed.where(F.col("reason").isNotNull()).select(
        F.lit(fmt.name).alias("format"),
        optional("file_source", "string").alias("file_source"),
        F.col("raw_log").alias("raw_line"),
        "reason",
        optional("created_at", "timestamp_ntz").alias("ingested_at"),
    )
