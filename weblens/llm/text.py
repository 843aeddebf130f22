"""Whole texts as words and word hashes, in numpy over Arrow columns.

A word is a run of `[^\\x20\\x09-\\x0D]`. All separators are ASCII, so words are found on the
UTF-8 bytes. A word's hash is a polynomial over a table of random byte values, taken modulo
2**64 and mixed; equal words have equal hashes, different words differ but for a chance of
about 2**-60 per pair. Work goes in blocks of about `BLOCK` bytes, so that memory holds a block
and the hashes of one text, not arrays over a whole Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

_SEPARATORS = [0x20, *range(0x09, 0x0E)]
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[_SEPARATORS] = False

_U = np.uint64
_BASE, _K1, _K2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> _U(31))) * _K1
    x = (x ^ (x >> _U(27))) * _K2
    return x ^ (x >> _U(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 4 * BLOCK:
            _powers[0] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans `data[start:end]`, which are in order and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(high - low + 1)
        sums = np.empty(high - low + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data[low:high]] * up[:high - low], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


@dataclass
class Block:
    """Some texts of a batch: rows `first` to `stop`, their bytes, where each text begins."""

    first: int
    stop: int
    data: np.ndarray
    offsets: np.ndarray

    def words(self, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text the number of its first word.

        `table` says which bytes are part of a word.
        """
        inside = table[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = self.offsets[1:] > self.offsets[:-1]
        begin, end = self.offsets[:-1][filled], self.offsets[1:][filled] - 1
        first[begin], last[end] = inside[begin], inside[end]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def tidy() -> None:
    """Give memory that is not in use back to the machine: a worker that waits for its next task keeps none."""
    pa.default_memory_pool().release_unused()
    # Where the C library has a way of its own to return freed memory.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """The texts of a string column in blocks of about `limit` bytes; a NULL is an empty text."""
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    if not len(column):
        return
    _, where, content = column.buffers()
    at = np.frombuffer(where, dtype=width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(content, dtype=np.uint8) if content is not None else np.empty(0, np.uint8)
    if column.null_count:
        missing = np.asarray(column.is_null())
        if (np.diff(at)[missing] > 0).any():
            yield from blocks(column.fill_null(""), limit)
            return
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield Block(i, j, data[at[i]:at[j]], at[i:j + 1] - at[i])
        i = j
    tidy()


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The texts of rows that a batch carries as structs in `row`: no second column of them is needed."""
    return pc.struct_field(batch.column("row"), name).cast(pa.string())


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of the whole sequence where there are fewer; none for none."""
    n = min(n, len(words))
    if not n:
        return np.empty(0, dtype=np.uint64)
    count = len(words) - n + 1
    out = words[:count] * _K1 + _U(n)
    for k in range(1, n):
        out = mix(out) + words[k:count + k]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in ascending order."""
    x = np.sort(x)
    return x if len(x) < 2 else x[np.concatenate(([True], x[1:] != x[:-1]))]


def shingle_sets(block: Block, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each text of a block its row and the ascending distinct hashes of its n-word runs."""
    starts, ends, at = block.words()
    words = span_hashes(block.data, starts, ends)
    runs = shingles(words, n) if len(words) >= n else words[:0]
    for i in range(block.stop - block.first):
        low, high = int(at[i]), int(at[i + 1])
        if high - low >= n:
            yield block.first + i, distinct(runs[low:high - n + 1])
        else:
            yield block.first + i, shingles(words[low:high], n)
