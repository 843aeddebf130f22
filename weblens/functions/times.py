"""Timestamp columns. All are wall-clock (`timestamp_ntz`), independent of the session zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# English month abbreviations in calendar order, as access logs write them.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def clf_time(day: Column, month: Column, year: Column, clock: Column) -> Column:
    """Common-log-format time from its pieces, e.g. 29, May, 2025, 14:30:45; NULL if no such time.

    The month is looked up by position; positions inside a name ('anf') are no month.
    """
    at = F.instr(F.lit(MONTHS), F.lower(month))
    number = F.floor((at + 2) / 3).cast("string")
    text = F.concat(year, F.lit("-"), number, F.lit("-"), day, F.lit(" "), clock)
    return F.when(at % 3 == 1, text.try_cast("timestamp_ntz"))


def iso_time(text: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss` with one- or two-digit parts; NULL for any other shape."""
    shape = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"
    return F.when(text.rlike(shape), F.regexp_replace(text, r"\s+", " ").try_cast("timestamp_ntz"))


def without_zone(text: Column) -> Column:
    """Cut the part of an ISO-like stamp that follows the seconds.

    A comma (milliseconds) decides first, then a plus sign, then a third minus sign.
    """
    minus_parts = F.size(F.split(text, "-"))
    return (
        F.when(F.contains(text, F.lit(",")), F.substring_index(text, ",", 1))
        .when(F.contains(text, F.lit("+")), F.substring_index(text, "+", 1))
        .when(minus_parts >= 4, F.regexp_replace(text, r"-[^-]*$", ""))
        .otherwise(text)
    )


def zone_offset(zone: Column) -> Column:
    """Keep a numeric zone such as `-0400`, NULL for anything else."""
    return F.when(zone.rlike(r"^[+-]\d{4}$"), zone)


def offset_seconds(offset: Column) -> Column:
    """Seconds east of UTC for a numeric zone; zero when the zone is unknown."""
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    hours = F.substring(offset, 2, 2).cast("int")
    minutes = F.substring(offset, 4, 2).cast("int")
    return F.coalesce(sign * (hours * 3600 + minutes * 60), F.lit(0))
