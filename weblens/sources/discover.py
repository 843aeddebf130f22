"""Finding log files below a folder and reading their lines."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamReader

from weblens import schemas
from weblens.formats import LogFormat
from weblens.session import path_kind
from weblens.sources import archives, files as listing

log = logging.getLogger(__name__)

Reader = TypeVar("Reader", DataFrameReader, DataStreamReader)

#: Archives are opened this deep by default: an archive, one inside it, one inside that.
MAX_DEPTH = 3


def glob_list(globs: str | Sequence[str]) -> list[str]:
    """Globs as a list; a text holds them separated by commas, `access.log*, other*.log`."""
    parts = globs.split(",") if isinstance(globs, str) else globs
    return [part.strip() for part in parts if part.strip()]


def listing_glob(globs: Sequence[str]) -> str:
    """One glob for Spark's file listing that matches any of `globs`, in any letter case.

    The listing's own globs tell letter case apart, so a letter becomes a set of both cases.
    A condition on file names would do as well, but it is evaluated again for every line.
    """
    def any_case(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            char = glob[i]
            end = glob.find("]", i + 2) if char == "[" else -1
            if end > 0:
                negation = "!" if glob[i + 1] == "!" else ""
                inner = glob[i + 1 + len(negation):end].replace("\\", "\\\\").replace("^", "\\^")
                both = inner.lower() + (inner.upper() if inner.upper() != inner.lower() else "")
                out, i = f"{out}[{negation}{both}]", end
            elif char in "*?":
                out += char
            elif char.lower() != char.upper():
                cases = dict.fromkeys((char, char.lower(), char.upper()))
                out += f"[{''.join(c for c in cases if len(c) == 1)}]"
            else:
                out += f"\\{char}" if char in "[]{},\\" else char
            i += 1
        return out

    return "{" + ",".join(any_case(glob) for glob in globs) + "}"


def listed(reader: Reader, globs: Sequence[str]) -> Reader:
    """A reader of all files below a folder whose names match; Spark leaves hidden names aside."""
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", listing_glob(globs))


def find(spark: SparkSession, folder: str, globs: Sequence[str]) -> listing.Listing | None:
    """The matching files of a folder; None, with a warning, where there is no folder."""
    found = path_kind(spark, folder)
    if found != "folder":
        log.warning("no folder at this path: %s" if found else "nothing at this path: %s", folder)
        return None
    return listing.walk(spark, folder, globs)


def _load(spark: SparkSession, kind: str, globs: Sequence[str], found: listing.Listing) -> DataFrame:
    """The matching files as a lazy frame, each once."""
    return listing.once(spark, listed(spark.read.format(kind), globs).load(found.roots), found)


def plain_lines(files: DataFrame, fmt: LogFormat) -> DataFrame:
    """Lines of the files that are not archives. Bytes that are not UTF-8 become U+FFFD."""
    name = F.col("_metadata.file_name")
    return files.where(~archives.is_archive(name)).select(
        F.make_valid_utf8("value").alias("value"),
        F.concat(F.lit(f"{fmt.name}:"), name).alias("file_source"),
        F.col("_metadata.file_path").alias("file_path"),
        F.lit(None).cast("string").alias("problem"),
    )


def read_plain(
    spark: SparkSession, folder: str, fmt: LogFormat, globs: str | Sequence[str] | None = None
) -> DataFrame:
    """Lines of the matching files that are not archives; a skipped row for each hidden file."""
    globs = glob_list(globs or fmt.globs)
    found = find(spark, folder, globs)
    if found is None:
        return spark.createDataFrame([], schemas.RAW_LINES)
    lines = plain_lines(_load(spark, "text", globs, found), fmt)
    hidden = found.paths(listing.SKIPPED)
    return lines.unionByName(listing.skipped_lines(spark, found, fmt.name)) if hidden else lines


def list_plain(
    spark: SparkSession, folder: str, fmt: LogFormat, globs: str | Sequence[str] | None = None
) -> DataFrame:
    """The files `read_plain` reads (`file_path`, `file_source`), also those without a line.

    Spark's listing leaves out files of zero bytes.
    """
    globs = glob_list(globs or fmt.globs)
    found = find(spark, folder, globs)
    if found is None:
        return spark.createDataFrame([], "file_path string, file_source string")
    files = _load(spark, "binaryFile", globs, found)
    name = F.col("_metadata.file_name")
    return files.where(~archives.is_archive(name)).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.concat(F.lit(f"{fmt.name}:"), name).alias("file_source"),
    )


def read_archived(
    spark: SparkSession, folder: str, fmt: LogFormat, globs: str | Sequence[str] | None = None,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """Lines of the matching members of the matching archives, nested ones included."""
    if not 1 <= max_depth <= 10:
        raise ValueError("max_depth must be between 1 and 10")
    globs = glob_list(globs or fmt.globs)
    found = find(spark, folder, globs)
    if found is None:
        return spark.createDataFrame([], schemas.RAW_LINES)
    return archived_lines(_load(spark, "binaryFile", globs, found), fmt, globs, max_depth)


def archived_lines(files: DataFrame, fmt: LogFormat, globs: Sequence[str], max_depth: int) -> DataFrame:
    """Lines of the archives among binary files, of a folder or of a stream.

    Sizes decide how an archive travels (see `archives.ALONE_BYTES` and `INLINE_BYTES`). The
    size reaches the scan as a filter, so content is read only where it is wanted.
    """
    name, size = F.col("_metadata.file_name"), F.col("length")
    wanted = files.where(archives.is_archive(name))
    alone, inline = archives.ALONE_BYTES, archives.INLINE_BYTES

    def blocks(some: DataFrame, content: Column) -> DataFrame:
        given = some.select(name.alias("name"), "path", content.alias("content"))
        return archives.expand(given, fmt.name, globs, max_depth)

    small = blocks(wanted.where(size <= alone), F.col("content"))
    medium = blocks(wanted.where((size > alone) & (size <= inline)), F.col("content"))
    large = blocks(wanted.where((size > alone) & (size > inline)), F.lit(None).cast("binary"))
    dealt = archives.deal_out(medium.unionByName(large))
    return archives.split_lines(small).unionByName(archives.split_lines(dealt))


def read_logs(
    spark: SparkSession, folder: str, fmt: LogFormat, globs: str | Sequence[str] | None = None,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """Every line of a format below a folder, from plain files and archives alike."""
    plain = read_plain(spark, folder, fmt, globs)
    return plain.unionByName(read_archived(spark, folder, fmt, globs, max_depth))
