"""Previews, samples, statistics and profiles of the log tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from weblens.formats import FORMATS

PREVIEW_LEAVES_OUT = ("raw_log",)


def newest(logs: DataFrame, limit: int, key: str = "id", stored: bool = False) -> DataFrame:
    """The `limit` rows with the largest key, largest first.

    For a stored table the key column is read alone first. The smallest wanted key then reaches
    the file scan as a filter, so that only row groups holding wanted rows are read in full.
    """
    order = [F.desc(key)] + ([F.desc("id")] if key != "id" else [])
    if stored:
        top = logs.select(key).orderBy(F.desc(key)).limit(limit)
        logs = logs.where(F.col(key) >= top.agg(F.min(key)).scalar())
    return logs.orderBy(*order).limit(limit)


def preview(logs: DataFrame, schema: T.StructType, limit: int = 10, stored: bool = False) -> DataFrame:
    """The newest rows without the raw line; times as ISO text."""
    shown = []
    for field in schema.fields:
        if field.name in PREVIEW_LEAVES_OUT or field.name not in logs.columns:
            continue
        is_time = isinstance(field.dataType, T.TimestampNTZType)
        shown.append(iso_text(field.name).alias(field.name) if is_time else F.col(field.name))
    return newest(logs, limit, stored=stored).select(*shown)


def iso_text(column: str) -> Column:
    """ISO 8601 text of a time, with microseconds only where there are any."""
    text = F.replace(F.col(column).cast("string"), F.lit(" "), F.lit("T"))
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)


def table_sample(
    tables: dict[str, DataFrame], name: str, limit: int = 10, by: str = "id", stored: bool = False
) -> DataFrame:
    """The newest rows of a table, all columns, by `id` or by `created_at`."""
    if name not in tables:
        raise ValueError(f"Invalid table name {name!r}. Must be one of: {sorted(tables)}")
    return newest(tables[name], limit, key=by, stored=stored)


def describe_sample(
    tables: dict[str, DataFrame], name: str, limit: int = 10, stored: bool = False
) -> dict:
    """A sample with its columns, its size and the table's row count."""
    rows = table_sample(tables, name, limit, by="created_at", stored=stored).collect()
    return {
        "table_name": name,
        "sample_data": [row.asDict() for row in rows],
        "columns": list(rows[0].asDict()) if rows else [],
        "total_rows": tables[name].count(),
        "sample_size": len(rows),
    }


def table_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Entries, distinct clients and days, first and last time per table, and the total entries.

    Rows are first reduced to one per client and day. Counting two distinct columns at once
    would copy every row for each of them; here only the reduced rows are copied.
    """
    def of(name: str, logs: DataFrame) -> DataFrame:
        reduced = (
            logs.groupBy("ip_address", F.to_date("timestamp").alias("day"))
            .agg(F.count("*").alias("n"), F.min("timestamp").alias("first"),
                 F.max("timestamp").alias("last"))
        )
        return reduced.agg(
            F.lit(name).alias("table_name"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_entries"),
            F.count_distinct("ip_address").alias("unique_ips"),
            F.count_distinct("day").alias("unique_days"),
            F.min("first").alias("earliest_log"),
            F.max("last").alias("latest_log"),
        )

    return reduce(DataFrame.unionByName, (of(name, logs) for name, logs in tables.items()))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and over all tables (`total`)."""
    counted = [
        logs.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        for name, logs in tables.items()
    ]
    per_table = reduce(DataFrame.unionByName, counted)
    return per_table.rollup("table_name").agg(F.sum("row_count").alias("row_count")).select(
        F.coalesce("table_name", F.lit("total")).alias("table_name"), "row_count"
    )


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of each table: position, name, type, constraints, the row count.

    Constraints come from the declared format, since files do not record them.
    """
    declared = {fmt.table_name: fmt.schema for fmt in FORMATS.values()}

    def of(name: str, logs: DataFrame) -> DataFrame:
        known = {f.name: f for f in declared.get(name, logs.schema).fields}
        columns = F.array(*(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.lit(not known.get(field.name, field).nullable).alias("not_null"),
                F.lit(field.name == "id").alias("primary_key"),
            )
            for position, field in enumerate(logs.schema.fields)
        ))
        size = logs.agg(F.count("*").alias("row_count"))
        return size.select(
            F.lit(name).alias("table_name"), F.inline(columns), "row_count"
        )

    return reduce(DataFrame.unionByName, (of(name, logs) for name, logs in tables.items()))
