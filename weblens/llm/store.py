"""Intermediate results in the cluster's shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from weblens.session import shared_folder


def stored(frame: DataFrame, purpose: str, *parts: str) -> DataFrame:
    """The rows written to the shared folder once and read back, so that they outlive executors.

    `parts` are columns to split the files by.
    """
    path = shared_folder(frame.sparkSession, f"llm-{purpose}")
    writer = frame.write.partitionBy(*parts) if parts else frame.write
    writer.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def again(key: str) -> Column:
    """A join key made anew from a column.

    An aggregate is already dealt out by its key, and a join on that very key would keep this
    dealing, which adaptive execution cannot split where one key is hot. A key of its own makes
    the join deal both sides out, and then it can.
    """
    return F.xxhash64(F.lit("again"), F.col(key))


def row_hash(frame: DataFrame, *seed: str) -> Column:
    """A hash over all columns of a row that can be hashed. Equal rows have equal hashes."""
    def plain(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return plain(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(plain(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    columns = [F.col(f"`{f.name}`") for f in frame.schema.fields if plain(f.dataType)]
    return F.xxhash64(*(F.lit(s) for s in seed), *columns)


def bit_table(frame: DataFrame, place: Column, bits: int) -> bytes:
    """A table of 2**bits bits in which the places of all rows are set.

    Its size is fixed by `bits`, whatever the number of rows, so it may travel with every task.
    """
    at = frame.select(place.alias("place"))
    marked = (
        at.selectExpr("CAST(place DIV 8 AS INT) AS at", "shiftleft(1, CAST(place % 8 AS INT)) AS bit")
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    table = np.zeros(1 << (bits - 3), np.uint8)
    table[np.asarray(marked["at"])] = np.asarray(marked["bits"]).astype(np.uint8)
    return table.tobytes()


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
