"""Exact counts of byte-level BPE tokens for a text and for every prefix of it, stored once.

Merges never cross the pieces that the tokenizer's pattern cuts a text into. Within a piece,
dropping the last token of an encoding leaves the encoding of a shorter prefix; so one pass over
a piece's bytes finds, for every prefix, its last token: the one that ends there and may follow
the last token of what is left. `count[end] = count[end - len(token)] + 1` then holds the exact
count at every prefix, and the last tokens lead back through the encoding itself. Two tokens may stand
next to each other if no merge across their border would have come before the merges that made them.

`with_prefixes` keeps both for every text: the count of each prefix of characters, as its difference to the one
before, and the bytes of each token. From these columns alone `cut` tells what a budget of tokens
leaves of a text, as the library's truncation does, and `counts_at` how many tokens a prefix has, as
the library counts it by itself; neither looks at the vocabulary or at a text again. A prefix that ends
inside a run of blanks, a contraction or a special token's string is cut into pieces otherwise than the whole text;
its count is that of its own pieces.

Pieces repeat, so a task remembers their counts, up to PIECES of them. The tokens that may end at a byte are those of a
state that the byte before and this one lead to, as in a search for many words at once; states are remembered as well.

Cases: a NULL text counts as an empty one, with 0 tokens. The string of a special token inside a
text is that one token, as the library has it by default. Texts are never cut, however long. Repeated rows are
counted alike, an empty table gives no rows. Further columns may have any name but those added, which are replaced.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from weblens.llm.store import stored
from weblens.llm.text import text_of

#: Different pieces that a task remembers before it starts anew.
PIECES = 500_000
#: Texts whose results leave a task together.
ROWS = 500
#: Fixed value: the pattern of byte-level BPE that cuts a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, letter to byte."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _range_set(kind: str) -> str:
    """All characters of a class of the `regex` module up to U+FFFF, as ranges for a set of `re`."""
    parts = ("".join(map(chr, span)) for span in (range(0xD800), range(0xE000, 0x10000)))
    runs = (run.group() for part in parts for run in regex.finditer(f"{kind}+", part))
    return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in runs)


def _plane_patterns() -> tuple[re.Pattern, re.Pattern]:
    """PATTERN and two blanks in a row for texts without characters above U+FFFF: `re` with the same sets takes half the time."""
    letter, number, blank = map(_range_set, (r"\p{L}", r"\p{N}", r"\s"))
    pieces = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letter}{number}]").replace(r"\p{L}", f"[{letter}]")
    pieces = pieces.replace(r"\p{N}", f"[{number}]").replace(r"\S", f"[^{blank}]").replace(r"\s", f"[{blank}]")
    return re.compile(pieces), re.compile(f"[{blank}][{blank}]")


class _State:
    """The longest end of some bytes that a token begins with: the tokens that may end there, longest first, each with
    its length and what it is known to follow or not, and the states behind the next byte, as far as met."""

    __slots__ = ("name", "tokens", "after")

    def __init__(self, name: bytes, tokens: list[tuple[bytes, int, dict[bytes, bool]]]) -> None:
        self.name, self.tokens, self.after = name, tokens, {}


class _Known(dict):
    """What `make` gives for a key, made where it is not there."""

    def __init__(self, make: Callable) -> None:
        self.make = make

    def __missing__(self, key):
        return self.make(key)


class PrefixCounter:
    """Token counts by a vocabulary file of the `tokenizers` library (byte-level BPE)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        letter = _byte_letters()

        def raw(text: str) -> bytes:
            return bytes(letter[c] for c in text)

        merges = [m if isinstance(m, list) else m.split(" ") for m in given["model"]["merges"]]
        pairs = [(raw(a), raw(b)) for a, b in merges]
        self.vocabulary = {raw(t) for t in given["model"]["vocab"] if all(c in letter for c in t)}
        #: When a pair is merged, and which pair made a token.
        self.turn = {pair: i for i, pair in enumerate(pairs)}
        #: The same turns by the left part, then by the right one.
        self._turns: dict[bytes, dict[bytes, int]] = {}
        for (a, b), i in self.turn.items():
            self._turns.setdefault(a, {})[b] = i
        self.made: dict[bytes, tuple[bytes, bytes]] = {}
        for a, b in pairs:
            self.made.setdefault(a + b, (a, b))
        self.longest = max(map(len, self.vocabulary))
        self.specials = sorted((t["content"] for t in given["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.pattern = regex.compile(PATTERN)
        self._plane, self._plane_run = _plane_patterns()
        self._borders: dict[bytes, tuple[tuple, tuple]] = {}
        self._known: dict[str, tuple[int, bytes | None, bytes]] = _Known(self._new_piece)
        #: Tokens that are the encoding of their own bytes.
        self.whole: set[bytes] = {t for t in self.vocabulary if len(t) == 1}
        for a, b in pairs:  # in the order of merges, so halves are known before the whole
            if self.made[a + b] == (a, b) and a in self.whole and b in self.whole and self._joins(a, b):
                self.whole.add(a + b)
        #: What such tokens begin with, themselves included.
        self.starts: set[bytes] = {t[:i] for t in self.whole for i in range(1, len(t) + 1)}
        self._forget()

    def _forget(self) -> None:
        """Start anew with what is remembered of pieces."""
        self._known.clear()
        self._follows: dict[bytes, dict[bytes, bool]] = {}
        self._states: dict[bytes, _State] = {}
        self._first = _State(b"", [])

    def _edges(self, token: bytes) -> tuple[tuple, tuple]:
        """What stands at the left and at the right border of a token while it is put together,
        each with the turn at which it is merged into something larger."""
        found = self._borders.get(token)
        if found is None:
            never = len(self.turn)
            left, right = [(token, never)], [(token, never)]
            while left[-1][0] in self.made:
                pair = self.made[left[-1][0]]
                left.append((pair[0], self.turn[pair]))
            while right[-1][0] in self.made:
                pair = self.made[right[-1][0]]
                right.append((pair[1], self.turn[pair]))
            found = self._borders[token] = (tuple(left), tuple(right))
        return found

    def _joins(self, first: bytes, second: bytes) -> bool:
        """Whether no merge across the border of two tokens comes before that of the two."""
        mine = self.turn[(first, second)]
        return not any(
            self.turn.get((a, b), mine) < min(mine, a_turn, b_turn + 1)
            for a, a_turn in self._edges(first)[1] for b, b_turn in self._edges(second)[0])

    def may_follow(self, first: bytes, second: bytes) -> bool:
        """Whether the encoding of both together is just these two tokens.

        A pair across the border is merged if its turn comes before either of its parts is
        merged into its own token; of equal turns the leftmost pair goes first.
        """
        right = self._edges(second)[0]
        for a, a_turn in self._edges(first)[1]:
            turns = self._turns.get(a)
            if turns is not None:
                for b, b_turn in right:
                    turn = turns.get(b)
                    if turn is not None and turn < a_turn and turn <= b_turn:
                        return False
        return True

    def _after(self, state: _State, byte: int) -> _State:
        """The state one byte further."""
        name = state.name + bytes((byte,))
        while name and name not in self.starts:
            name = name[1:]
        found = self._states.get(name)
        if found is None:
            ends = (name[i:] for i in range(len(name)))
            found = self._states[name] = _State(name, [(t, len(t), self._follows.setdefault(t, {})) for t in ends if t in self.whole])
        state.after[byte] = found
        return found

    def prefix_counts(self, piece: bytes) -> tuple[list[int], list[bytes]]:
        """The number of tokens of every prefix of a piece, from the empty one to the whole, and the last of them."""
        counts, last, state = [0], [b""], self._first
        for end, byte in enumerate(piece, 1):
            state = state.after.get(byte) or self._after(state, byte)
            for token, size, follows in state.tokens:
                start = end - size
                if not start:
                    break
                before = last[start]
                good = follows.get(before)
                if good is None:
                    good = follows[before] = self.may_follow(before, token)
                if good:
                    break
            counts.append(counts[start] + 1)
            last.append(token)
        return counts, last

    def piece(self, piece: str) -> tuple[int, bytes | None, bytes]:
        """The number of tokens of a piece, the steps between the counts of its prefixes of characters,
        one byte each (None if one does not fit), and the bytes of its tokens, 16 bits each."""
        return self._known[piece]

    def _new_piece(self, piece: str) -> tuple[int, bytes | None, bytes]:
        if len(self._known) >= PIECES:
            self._forget()
        data = piece.encode()
        counts, last = self.prefix_counts(data)
        sizes, end = [], len(data)
        while end:
            sizes.append(len(last[end]))
            end -= sizes[-1]
        if len(data) != len(piece):
            ends = accumulate((len(c.encode()) for c in piece), initial=0)
            counts = [counts[e] for e in ends]
        if piece[0] == "'" and len(piece) > 2 and self.pattern.fullmatch(piece[:2]) is None:
            # The front of a contraction is no piece of its own.
            counts[2] = sum(self.piece(p)[0] for p in self.pattern.findall(piece[:2]))
        try:
            steps = array("b", map(sub, counts[1:], counts)).tobytes()
        except OverflowError:
            steps = None
        sizes.reverse()
        found = self._known[piece] = len(sizes), steps, array("H", sizes).tobytes()
        return found

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """The pieces of a text in order; True for the string of a special token."""
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            yield from ((p, False) for p in self.pattern.findall(text[at:found.start()]))
            yield found.group(), True
            at = found.end()
        yield from ((p, False) for p in self.pattern.findall(text[at:] if at else text))

    def _counts(self, piece: str) -> np.ndarray:
        """The count of every prefix of characters of a piece, without the empty one."""
        n, steps, _ = self.piece(piece)
        if steps is not None:
            return np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
        counts, _ = self.prefix_counts(piece.encode())
        return np.array([counts[e] for e in accumulate(len(c.encode()) for c in piece)], np.int64)

    def _fast(self, pieces: list[str], runs: bool) -> tuple[int, bytes, bytes] | None:
        """What `table` tells, put together from pieces; None if a step does not fit one byte."""
        piece = self.piece
        found = list(map(self._known.__getitem__, pieces))
        sizes = b"".join([f[2] for f in found])
        try:
            steps = b"".join([f[1] for f in found])
        except TypeError:  # a piece without steps
            return None
        if runs:
            fixed = np.frombuffer(steps, np.int8).astype(np.int64)
            at = 0
            for i, (this, after) in enumerate(zip(pieces, pieces[1:])):
                at += len(this)
                if this.isspace() and after[0].isspace():
                    # Up to here the blanks are one piece; the next character finds the old count again.
                    change = piece(this + after[0])[0] - found[i][0] - fixed[at]
                    fixed[at] += change
                    fixed[at + 1:at + 2] -= change
            if fixed.min() < -128 or fixed.max() > 127:
                return None
            steps = fixed.astype(np.int8).tobytes()
        return len(sizes) // 2, b"\x01" + steps, sizes

    def table(self, text: str) -> tuple[int, bytes, bytes]:
        """The number of tokens, the steps of the counts of all prefixes, and the bytes of all tokens."""
        if not any(special in text for special in self.specials):
            in_plane = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
            cut, run = (self._plane, self._plane_run) if in_plane else (self.pattern, _RUN)
            found = self._fast(cut.findall(text), run.search(text) is not None)
            if found is not None:
                return found
        # Counts of prefixes that end where the whole text's pieces do not apply are told one by one.
        done, at, before = 0, 0, ""
        counts, sizes = [], []
        for piece, special in self.pieces(text):
            if special:
                inside = np.empty(len(piece), np.int64)
                base = done - (self.piece(before)[0] if before else 0)
                for k in range(1, len(piece)):
                    inside[k - 1] = base + sum(self.piece(p)[0] for p in self.pattern.findall(before + piece[:k]))
                inside[-1] = done + 1
                sizes.append(np.array([len(piece.encode())], "<u2").tobytes())
                done += 1
            else:
                inside = done + self._counts(piece)
                if before and before.isspace() and piece[0].isspace():
                    inside[0] = done - self.piece(before)[0] + self.piece(before + piece[0])[0]
                sizes.append(self.piece(piece)[2])
                done += self.piece(piece)[0]
            counts.append(inside)
            before = "" if special else piece
        steps = np.diff(np.concatenate(counts), prepend=0) if counts else np.empty(0, np.int64)
        width = next(w for w in (1, 2, 4) if not len(steps) or np.abs(steps).max() < 1 << (8 * w - 1))
        return done, bytes([width]) + steps.astype(f"<i{width}").tobytes(), b"".join(sizes)


#: Two blanks in a row: only there may a prefix have other pieces than the text.
_RUN = regex.compile(r"\s\s")

_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, made once per process."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _extended(frame: DataFrame, read: list[Column], added: list[T.StructField], values) -> DataFrame:
    """`frame` with columns that `values` makes from batches of the columns `read`; like-named ones are replaced."""
    names = [f.name for f in added]
    given = frame.select(F.struct(*(F.col(f"`{c}`") for c in frame.columns if c not in names)).alias("row"), *read)
    schema = T.StructType([given.schema["row"], *added])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns, part in values(batch):
                yield pa.RecordBatch.from_arrays([part.column("row"), *columns], names=["row", *names])

    return given.mapInArrow(task, schema).select("row.*", *(F.col(f"`{n}`") for n in names))


def with_prefixes(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """`docs` with n_bytes, n_tokens, over_limit, prefix_steps and token_sizes (see above)."""
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
             T.StructField("prefix_steps", T.BinaryType()), T.StructField("token_sizes", T.BinaryType())]

    def values(batch: pa.RecordBatch):
        tokens = counter(path)
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            texts = [t or "" for t in text_of(part).to_pylist()]
            counts, steps, sizes = zip(*map(tokens.table, texts))
            yield [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts]),
                   pa.array(steps, pa.binary()), pa.array(sizes, pa.binary())], part

    return _extended(docs, [], added, values)


def with_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit."""
    return with_prefixes(docs, path, limit).drop("prefix_steps", "token_sizes")


def cut(stored_prefixes: DataFrame, budgets: list[int]) -> DataFrame:
    """With bytes_<budget>: how many bytes of the text its first tokens cover, at most `budget` of them."""
    added = [T.StructField(f"bytes_{b}", T.LongType()) for b in budgets]

    def values(batch: pa.RecordBatch):
        sizes = [np.frombuffer(x.as_buffer(), "<u2") if x.is_valid else np.empty(0, "<u2") for x in batch.column("sizes")]
        yield [pa.array([int(s[:b].sum(dtype=np.int64)) for s in sizes], pa.int64()) for b in budgets], batch

    return _extended(stored_prefixes, [F.col("token_sizes").alias("sizes")], added, values)


def counts_at(stored_prefixes: DataFrame, lengths: list[int]) -> DataFrame:
    """With tokens_<length>: the number of tokens of the text's first characters, as many as `length` or all."""
    added = [T.StructField(f"tokens_{n}", T.LongType()) for n in lengths]

    def values(batch: pa.RecordBatch):
        steps = [prefix_steps(x.as_py() if x.is_valid else b"") for x in batch.column("steps")]
        yield [pa.array([int(s[:n].sum(dtype=np.int64)) for s in steps], pa.int64()) for n in lengths], batch

    return _extended(stored_prefixes, [F.col("prefix_steps").alias("steps")], added, values)


def prefix_steps(stored_steps: bytes) -> np.ndarray:
    """The differences between the counts of a text's prefixes, one per character."""
    return np.frombuffer(stored_steps, f"<i{stored_steps[0]}", offset=1) if stored_steps else np.empty(0, np.int8)


def counted_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and bytes_1024 of each row, read from the stored prefixes."""
    kept = stored(with_prefixes(docs.select("doc_id", "text"), path).drop("text"), "prefixes")
    return cut(kept, [1024]).select("doc_id", "n_bytes", "n_tokens", "over_limit", "bytes_1024")
