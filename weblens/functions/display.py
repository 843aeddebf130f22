"""Presentation columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KIB = 1024
MIB = 1024 * 1024


def status_class(status: Column) -> Column:
    """Label of an HTTP status: success, redirect, client-error, server-error or unknown."""
    hundreds = F.floor(status / 100)
    return (
        F.when(hundreds == 2, "success")
        .when(hundreds == 3, "redirect")
        .when(hundreds == 4, "client-error")
        .when(hundreds >= 5, "server-error")
        .otherwise("unknown")
    )


def human_size(size: Column) -> Column:
    """Bytes as `512B`, `1.5KB` or `2.0MB`; `-` for none and for zero."""
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "-")
        .when(size < KIB, F.concat(size.cast("string"), F.lit("B")))
        .when(size < MIB, F.format_string("%.1fKB", size / KIB))
        .otherwise(F.format_string("%.1fMB", size / MIB))
    )


def truncate_text(text: Column, limit: int) -> Column:
    """The text, or its first `limit` characters and `...` when it is longer."""
    cut = F.concat(F.substring(text, 1, limit), F.lit("..."))
    return F.when(F.char_length(text) > limit, cut).otherwise(text)


def cell_text(value: Column) -> Column:
    """Any value as text, NULL as the empty string."""
    return F.coalesce(value.cast("string"), F.lit(""))
