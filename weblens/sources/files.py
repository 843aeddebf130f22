"""The files below a folder: one row each, by the file's real place.

Spark's own listing leaves out names that start with `_` or `.`, and gives a link as a file of its own.
So the folder is walked once on the driver, names only: hidden folders become further roots of the
readers, a file that is listed more than once is read under one of its names, and a hidden file,
which Spark's sources cannot be made to read, is told as skipped. Linked folders are not entered.

Walking costs about a millisecond a name where the file system is not the driver's own; the readers
list the files again, in parallel.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weblens.session import file_system

HIDDEN = "Hidden file: its name starts with _ or ."
READ, DUPLICATE, SKIPPED = "read", "duplicate", "hidden"

FILE, FOLDER, LINKED = "file", "folder", "linked folder"
Entry = tuple[str, str, str, int, str]


@dataclass(frozen=True)
class Listing:
    """What a walk found: the roots to read, linked folders, which Spark would enter, and all matching
    files with what becomes of each."""

    roots: list[str]
    linked: list[str]
    files: list[tuple[str, str, str, int, str]]

    def paths(self, state: str) -> list[str]:
        return [path for path, _, _, _, what in self.files if what == state]


def _local(folder: str) -> Iterator[Entry]:
    """(path, name, real path, size, kind) of everything below a folder of this machine."""
    for root, folders, names in os.walk(folder):
        for name in sorted(folders):
            path = os.path.join(root, name)
            yield path, name, path, 0, LINKED if os.path.islink(path) else FOLDER
        for name in sorted(names):
            path = os.path.join(root, name)
            if os.path.isfile(path):  # a link may lead nowhere
                yield path, name, os.path.realpath(path), os.path.getsize(path), FILE


def _remote(system, folder) -> Iterator[Entry]:
    waiting = [folder]
    while waiting:
        for found in system.listStatus(waiting.pop()):
            path, real, kind = found.getPath(), found.getPath(), FOLDER if found.isDirectory() else FILE
            if found.isSymlink():
                real = system.resolvePath(path)
                found = system.getFileStatus(real)
                kind = LINKED if found.isDirectory() else FILE
            elif kind == FOLDER:
                waiting.append(path)
            yield path.toString(), path.getName(), real.toString(), found.getLen(), kind


def _is_hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def walk(spark: SparkSession, folder: str, globs: Sequence[str]) -> Listing:
    """Everything below a folder whose name matches one of the globs, in any letter case."""
    jvm_path, system = file_system(spark, folder)
    # Only the driver's own file system has links that look like files.
    local = system.getUri().getScheme() == "file"
    entries = _local(jvm_path.toUri().getPath()) if local else _remote(system, jvm_path)
    roots, linked, found = [folder], [], []
    for path, name, real, size, kind in entries:
        if kind == LINKED:
            linked.append(path)
        elif kind == FOLDER:
            if _is_hidden(name):
                roots.append(path)
        elif any(fnmatch.fnmatchcase(name.lower(), glob.lower()) for glob in globs):
            found.append((path, name, real, size))
    # Of a file's names its own comes first, then the others in order; a hidden one last, as it cannot be read.
    order = sorted(found, key=lambda f: (_is_hidden(f[1]), f[0] != f[2], f[0]))
    seen: set[str] = set()
    files = []
    for path, name, real, size in order:
        state = DUPLICATE if real in seen else SKIPPED if _is_hidden(name) else READ
        seen.add(real)
        files.append((path, name, real, size, state))
    return Listing(roots, linked, files)


def _plain_uri(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def uri(spark: SparkSession, path: str) -> str:
    """A path as `_metadata.file_path` has it, but for the slashes behind `file:`."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()
    return made if urlparse(made).scheme else f"file:{made}"


def once(spark: SparkSession, files: DataFrame, listing: Listing) -> DataFrame:
    """Files of a reader without those that are another's duplicate; Spark prunes them before it opens any."""
    path = _plain_uri(F.col("_metadata.file_path"))
    for folder in listing.linked:
        files = files.where(~F.startswith(path, F.lit(f"{uri(spark, folder)}/")))
    duplicates = [uri(spark, path) for path in listing.paths(DUPLICATE)]
    return files.where(~path.isin(duplicates)) if duplicates else files


def skipped_lines(spark: SparkSession, listing: Listing, log_type: str) -> DataFrame:
    """A row with its reason for each hidden file, in the shape of `schemas.RAW_LINES`."""
    rows = [(None, f"{log_type}:{name}", uri(spark, path), HIDDEN) for path, name, _, _, state in listing.files if state == SKIPPED]
    return spark.createDataFrame(rows, "value string, file_source string, file_path string, problem string")


def file_table(spark: SparkSession, listing: Listing, log_type: str) -> DataFrame:
    """file_path, file_source, real_path, size and state (`read`, `duplicate`, `hidden`) of each matching name."""
    rows = [(unquote(uri(spark, path)), f"{log_type}:{name}", real, size, state) for path, name, real, size, state in listing.files]
    return spark.createDataFrame(rows, "file_path string, file_source string, real_path string, size long, state string")
