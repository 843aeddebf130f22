"""Incremental ingest: what was added to a folder since the last run is parsed and stored.

The same readers, parser and tables as the batch ingest, rotated and packed logs included. Plain
files and archives are two sources of one stream, each remembers what it has seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weblens.formats import FORMATS, LogFormat
from weblens.plans.ingest import LogStore
from weblens.sources.discover import MAX_DEPTH, archived_lines, glob_list, listed, plain_lines

# The columns of Spark's binary file source, which a stream must be told.
BINARY_FILES = "path string, modificationTime timestamp_ltz, length long, content binary"


def stream_lines(
    spark: SparkSession, folder: str, fmt: LogFormat, globs: str | Sequence[str] | None = None,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Lines of the files and archives of a folder as a stream, in the shape of `schemas.RAW_LINES`."""
    globs = glob_list(globs or fmt.globs)

    def stream(kind: str, schema: str) -> DataFrame:
        reader = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch)
        return listed(reader, globs).load(folder)

    plain = plain_lines(stream("text", "value string"), fmt)
    return plain.unionByName(archived_lines(stream("binaryFile", BINARY_FILES), fmt, globs, MAX_DEPTH))


def ingest_new_files(
    store: LogStore, folder: str, fmt: LogFormat | str, checkpoint: str,
    globs: str | Sequence[str] | None = None,
) -> StreamingQuery:
    """Store all files not seen before, then stop.

    The checkpoint remembers the files. A batch keeps its number when it is retried, and the
    store replaces what an earlier try of that number left, so every line is stored once. The
    numbers belong to the checkpoint: another checkpoint is another origin to the store.
    """
    origin = f"stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"
    fmt = FORMATS[fmt] if isinstance(fmt, str) else fmt
    lines = stream_lines(store.spark, folder, fmt, globs)

    def save(batch: DataFrame, number: int) -> None:
        store.write(batch, fmt, origin=origin, ingest=number)

    return (
        lines.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
