"""Lines out of gzip, tar and zip archives.

The container formats have no reader in Spark, so this one operator runs in Python. A task
gets whole archives (compressed streams cannot be split) but holds neither a member nor a large
archive unpacked: members are read as streams and leave as blocks of about `BLOCK_BYTES`,
which the JVM cuts into lines. No line is ever a Python object.

A link in a tar stands for the member it names. One that names no file, and a member that a later
one of the same name replaces, is one row with its reason; the rest is read. Only what is wrong
with the bytes of an archive makes it unreadable: if they can not be read, the task fails.

A compressed tar of up to `SPOOL_BYTES` unpacked is unpacked once, in memory.

An archive counts only as a whole. It is read through once to see that it is sound, and again
to hand out its lines, so that a truncated file contributes nothing instead of a part. An archive inside
another is copied out first, to memory or, beyond `SPOOL_BYTES`, to a file that ends with it: both readings
then stay within it, where going back in the outer stream would unpack that from its start each time.
"""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import io
import itertools
import lzma
import posixpath
import re
import shutil
import struct
import tarfile
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BYTES = 4 << 20

#: An archive up to this size is parsed by the task that unpacks it. The blocks of a larger one
#: are dealt out to all tasks first, as parsing takes far longer than unpacking.
ALONE_BYTES = 32 << 20

#: An archive up to this size arrives as the content of a row; a larger one is streamed by the
#: task from its path.
INLINE_BYTES = 256 << 20

# Name endings that make a file an archive.
TAR_ENDINGS = (".tar", ".tar.gz", ".tar.bz2")
ARCHIVE_ENDINGS = (*TAR_ENDINGS, ".zip", ".gz")

_BLOCKS = pa.schema([
    ("block", pa.binary()), ("number", pa.int64()), ("file_source", pa.string()),
    ("file_path", pa.string()), ("problem", pa.string()),
])
_SPARK_BLOCKS = "block binary, number long, file_source string, file_path string, problem string"

#: An archive inside another is held in memory up to this size.
SPOOL_BYTES = 32 << 20

#: A line longer than this is handed out in pieces, so that a member without line ends is never held whole.
LINE_BYTES = 64 << 20

Member = tuple[str, Callable[[], BinaryIO]]


def is_archive(name: Column) -> Column:
    """Whether a file name denotes an archive, in any letter case."""
    end = F.lower(F.right(name, F.lit(max(map(len, ARCHIVE_ENDINGS)))))
    return reduce(Column.__or__, (F.endswith(end, F.lit(ending)) for ending in ARCHIVE_ENDINGS))


class StorageFailure(Exception):
    """The bytes of an archive could not be read from where it lies."""


class NoTarget(Exception):
    """A link in an archive names no file of it."""


#: What damaged bytes raise while they are unpacked. OSError is among them, as gzip and bz2 raise
#: it; errors of the storage never get here as such, see `Watched`.
FORMAT_ERRORS = (
    tarfile.TarError, zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, OSError,
    NotImplementedError, RuntimeError, ValueError, struct.error,
)


class Watched(io.RawIOBase):
    """A stream whose own failures can be told from damage found in its bytes."""

    def __init__(self, inner: BinaryIO) -> None:
        self._inner = inner

    def _tried(self, action: Callable[[], int | bytes]) -> int | bytes:
        try:
            return action()
        except (OSError, ValueError) as problem:
            raise StorageFailure(str(problem)) from problem

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, target: memoryview) -> int:
        data = self._tried(lambda: self._inner.read(len(target)))
        target[:len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        return self._tried(lambda: self._inner.seek(offset, whence))

    def tell(self) -> int:
        return self._tried(self._inner.tell)


def is_safe(name: str) -> bool:
    """Whether a member name stays below the archive.

    Either slash separates the name's components: none may lead up, the first may be neither a
    root nor a drive. A single backslash, which some systems read as an escape, is refused.
    """
    components = re.split(r"[/\\]", name)
    rooted = components[0] == "" or re.fullmatch(r"[A-Za-z]:.*", components[0])
    single_backslash = re.search(r"(?<!\\)\\(?!\\)", name)
    return not (rooted or single_backslash or ".." in components)


def _link_target(tar: tarfile.TarFile, link: tarfile.TarInfo) -> BinaryIO:
    try:
        content = tar.extractfile(link)
    except (KeyError, RecursionError):
        content = None
    if content is None:
        raise NoTarget(f"Link without a file: {link.linkname}")
    return content


def _tar_members(stream: BinaryIO, mode: str = "r:*") -> Iterator[Member]:
    with tarfile.open(fileobj=stream, mode=mode) as tar:
        for info in tar:
            if info.isfile():
                yield info.name, lambda info=info: tar.extractfile(info)
            elif info.islnk() or info.issym():
                yield info.name, lambda info=info: _link_target(tar, info)


def _zip_members(stream: BinaryIO) -> Iterator[Member]:
    with zipfile.ZipFile(stream) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                yield info.filename, lambda info=info: archive.open(info)


def _gzip_member(stream: BinaryIO, name: str) -> Iterator[Member]:
    yield name[:-len(".gz")], lambda: gzip.GzipFile(fileobj=stream, mode="rb")


def _members(stream: BinaryIO, name: str) -> Iterator[Member]:
    """Members of an archive in order; a member must be read before the next is asked for."""
    stream.seek(0)
    lower = name.lower()
    if lower.endswith(TAR_ENDINGS):
        return _tar_members(stream, "r:" if isinstance(stream, Unpacked) else "r:*")
    if lower.endswith(".zip"):
        return _zip_members(stream)
    return _gzip_member(stream, posixpath.basename(name))


class Unpacked(io.BytesIO):
    """What a compressed tar unpacks to."""


def _unpacked(stream: BinaryIO, name: str) -> Unpacked | None:
    """A compressed tar unpacked in memory; None if it is none, is damaged or has more than SPOOL_BYTES.

    Both readings and all links go back in the tar, and each step back in the compressed stream would
    unpack it from its start.
    """
    if not name.lower().endswith(TAR_ENDINGS):
        return None
    stream.seek(0)
    start = stream.read(3)
    stream.seek(0)
    gzipped = start.startswith(b"\x1f\x8b")
    if not gzipped and start != b"BZh":
        return None
    made = Unpacked()
    try:
        with gzip.GzipFile(fileobj=stream, mode="rb") if gzipped else bz2.BZ2File(stream) as content:
            while data := content.read(1 << 20):
                if made.tell() + len(data) > SPOOL_BYTES:
                    return None
                made.write(data)
    except FORMAT_ERRORS:
        return None
    return made


def _last_positions(stream: BinaryIO, name: str) -> dict[str, int]:
    """Read the archive through; for each safe member name the place of its last occurrence.

    Raises if the archive is damaged. A later member of the same name replaces an earlier one.
    """
    last = {}
    for position, (member, open_member) in enumerate(_members(stream, name)):
        if not is_safe(member):
            continue
        try:
            with open_member() as content:
                while content.read(1 << 20):
                    pass
        except NoTarget:
            continue
        last[posixpath.normpath(member)] = position
    return last


def _blocks(content: BinaryIO) -> Iterator[bytes]:
    """The content in blocks that end at a line end; line ends are unified to a line feed."""
    ready, pending, held = b"", [], b""
    while data := content.read(BLOCK_BYTES):
        data = held + data
        # A carriage return at the very end may be one half of a pair.
        held = data[-1:] if data.endswith(b"\r") else b""
        data = data[:len(data) - len(held)].replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        cut = data.rfind(b"\n") + 1
        if cut:
            if ready:
                yield ready
            ready, pending = b"".join((*pending, data[:cut])), []
        pending.append(data[cut:])
        if sum(map(len, pending)) > LINE_BYTES:
            yield b"".join((ready, *pending, b"\n"))
            ready, pending = b"", []
    if rest := b"".join((ready, *pending)):
        yield rest


def _walk(
    stream: BinaryIO, chain: tuple[str, ...], globs: Sequence[str], depth_left: int
) -> Iterator[tuple[tuple[str, ...], bytes | None, str | None]]:
    """(chain of names, block, problem) of everything wanted inside an archive."""
    if depth_left <= 0:
        yield chain, None, "Maximum archive depth reached"
        return
    last, unpacked = None, _unpacked(stream, chain[-1])
    if unpacked is not None:
        try:
            last = _last_positions(unpacked, chain[-1])
            stream = unpacked
        except FORMAT_ERRORS:
            pass  # what is wrong is told by the archive itself
    try:
        last = _last_positions(stream, chain[-1]) if last is None else last
    except FORMAT_ERRORS as problem:
        yield chain, None, f"Unreadable archive: {problem}"
        return
    for position, (member, open_member) in enumerate(_members(stream, chain[-1])):
        inner = (*chain, member)
        if not is_safe(member):
            yield inner, None, "Unsafe path in archive"
            continue
        base = posixpath.basename(member).lower()
        wanted = any(fnmatch.fnmatchcase(base, glob.lower()) for glob in globs)
        if not wanted:
            continue
        try:
            opened = open_member()
        except NoTarget as problem:
            yield inner, None, str(problem)
            continue
        if last[posixpath.normpath(member)] != position:
            yield inner, None, "Replaced by a later member of the same name"
            continue
        with opened as content:
            if base.endswith(ARCHIVE_ENDINGS) and depth_left > 1:
                with tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES) as copy:
                    shutil.copyfileobj(content, copy, 1 << 20)
                    yield from _walk(copy, inner, globs, depth_left - 1)
            elif base.endswith(ARCHIVE_ENDINGS):
                yield from _walk(content, inner, globs, depth_left - 1)
            else:
                for block in _blocks(content):
                    yield inner, block, None


def _open_path(path: str) -> BinaryIO:
    """A seekable stream over a file too large to travel as one value."""
    from pyarrow import fs

    for hadoop_scheme in ("s3a://", "s3n://"):
        path = path.replace(hadoop_scheme, "s3://", 1)
    filesystem, inner = fs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


def expand(files: DataFrame, log_type: str, globs: Sequence[str], max_depth: int) -> DataFrame:
    """Blocks of lines from archives given as (name, path, content); content NULL: read `path`."""
    globs = list(globs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c) for c in ("name", "path", "content"))
            for name, path, content in zip(*columns):
                yield from one(name.as_py(), path.as_py(), content)

    def one(name: str, path: str, content: pa.Scalar) -> Iterator[pa.RecordBatch]:
        number = itertools.count()

        def row(chain: tuple[str, ...], block: bytes | None, problem: str | None) -> pa.RecordBatch:
            source = f"{log_type}:{'->'.join(chain)}"
            values = ([block], [next(number)], [source], [path], [problem])
            arrays = [pa.array(v, field.type) for v, field in zip(values, _BLOCKS)]
            return pa.RecordBatch.from_arrays(arrays, schema=_BLOCKS)

        with io.BytesIO(content.as_py()) if content.is_valid else _open_path(path) as raw:
            for found in _walk(io.BufferedReader(Watched(raw)), (name,), globs, max_depth):
                yield row(*found)

    return files.mapInArrow(task, _SPARK_BLOCKS)


def deal_out(blocks: DataFrame) -> DataFrame:
    """Spread blocks evenly. The place of a block depends on nothing but the block."""
    return blocks.repartition("file_path", "number")


def split_lines(blocks: DataFrame) -> DataFrame:
    """Blocks cut into lines, in the shape of `schemas.RAW_LINES`."""
    text = F.make_valid_utf8(F.col("block").cast("string"))
    # A block of a problem row is NULL; its one element is NULL as well.
    lines = F.when(F.col("problem").isNull(), F.split(text, "\n")).otherwise(
        F.array(F.lit(None).cast("string"))
    )
    return blocks.select(F.explode(lines).alias("value"), "file_source", "file_path", "problem")
