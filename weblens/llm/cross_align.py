"""Two tokenizers' tokens of the same text aligned at the byte offsets where both end a token.

Divide and conquer: in a text, a token end of A near the middle is looked up among the ends of B by
bisection; a common end cuts the text into two halves, which are cut the same way. After a few
tries around the middle, an interval's remaining ends are looked up at once and the common end
nearest to the middle is taken. In an interval of at most GRAIN tokens all ends are looked up, and
every common one cuts. What has no common end inside is a leaf: one group of A tokens and B tokens that
cover the same bytes. All intervals of a block of texts are cut together, level by level, in numpy.

Within a group, tokens of A and B are linked if their bytes overlap. Every stretch between two
neighbouring token ends, of whichever side, is one link. Links of each id pair are counted over all
texts; the counts then say how often each link of a text occurs in the corpus and whether its A id
is the one that its B id meets most often.

Tokens are written to the shared folder once, as packed ids, and read back for counting and for
scoring. The most frequent pairs (at most HEAD, told by exact counts) travel with the tasks; links
of all other pairs join their counts in Spark, so that any number of pairs can be handled.

A is a byte-level vocabulary of the tokenizers library, B a byte-fallback one of sentencepiece; A
encodes a blank and the text, B adds the blank itself. Where the vocabulary's merges allow no other
result (see `Encoder`), A is encoded by tiktoken from the same file, several times as fast.

Cases: a text that is NULL or empty, or whose tokens of either side do not spell blank and text
again, has no tokens: all its counts are 0 and its digest is an empty string. Special tokens' strings are plain
text. Texts are never cut. Repeated rows are rows of their own, a NULL id is kept, an empty table
gives no rows. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from weblens.llm.store import stored

#: Id pairs whose counts travel with the tasks: 16 MB.
HEAD = 1_000_000
#: Bytes that a task aligns at once, and pairs that it sums up before it hands them on.
BLOCK, PAIRS = 1_000_000, 500_000
#: Single looks around the middle of an interval before all its ends are looked up.
LOOKS = 4
#: Tokens of an interval that is not halved any more.
GRAIN = 16

#: Fixed value: the pattern of byte-level BPE that cuts a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters, digits and blanks that every version of Unicode tells apart in the same way.
_SETTLED = regex.compile(r"[^\u0000-\u036F]")


def _byte_of_letter() -> dict[str, int]:
    """The byte that each printable letter of a byte-level vocabulary stands for."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(a_path)
        self.library.encode_special_tokens = True
        letters = _byte_of_letter()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.a_bytes[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.quick = self._quick(a_path)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))

    def _piece(self, number: int) -> bytes:
        piece = self.pieces.id_to_piece(number)
        if self.pieces.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def _quick(self, path: str):
        """A tiktoken encoding of the same vocabulary, or None where it might differ.

        The library merges listed pairs, tiktoken any pair that spells a token; both take the least
        rank first. If ids follow the merges and every token's own bytes encode to that token, then
        whatever spells a token has been merged from its listed pair: inside those bytes, no merge
        has crossed their border, so they have come to the same two parts as by themselves.
        """
        import tiktoken

        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, split = given["model"], given.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
                 and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
                 and not given.get("normalizer") and split.get("type") == "ByteLevel"
                 and not split.get("add_prefix_space") and split.get("use_regex", True))
        if not plain:
            return None
        vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first = len(vocabulary) - len(merges)
        if first != 256 or any(vocabulary.get(a + b) != first + i for i, (a, b) in enumerate(merges)):
            return None
        whole = sorted(vocabulary, key=vocabulary.get)
        bare = self.library.model
        if any([t.id for t in bare.tokenize(token)] != [vocabulary[token]] for token in whole):
            return None
        ranks = {self.a_bytes[number]: number for number in vocabulary.values()}
        return tiktoken.Encoding("quick", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def a(self, texts: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return [self.library.encode(t, add_special_tokens=False).ids if _SETTLED.search(t) else self.quick.encode_ordinary(t)
                for t in texts]

    def b(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(a_path: str, b_path: str) -> Encoder:
    """The encoder of two files, made once per process."""
    if (a_path, b_path) not in _encoders:
        _encoders[a_path, b_path] = Encoder(a_path, b_path)
    return _encoders[a_path, b_path]


def _inside(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some intervals, and which interval each is in."""
    size = high - low
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) + (low - np.cumsum(size) + size)[owner], owner


def common_ends(a: np.ndarray, b: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `a` and `b`, ascending token ends, where both are equal.

    The stops are the last places of each text, whose ends are equal; they are the first cuts.
    """
    found_a, found_b = [a_stops], [b_stops]
    al, bl = np.append(0, a_stops[:-1] + 1), np.append(0, b_stops[:-1] + 1)
    ah, bh = a_stops, b_stops  # ends inside an interval are those before its last
    while True:
        alive = (al < ah) & (bl < bh)
        al, ah, bl, bh = al[alive], ah[alive], bl[alive], bh[alive]
        small = ah - al <= GRAIN
        if small.any():
            at, _ = _inside(al[small], ah[small])
            place = np.searchsorted(b, a[at])
            common = b[place] == a[at]
            found_a.append(at[common])
            found_b.append(place[common])
            al, ah, bl, bh = al[~small], ah[~small], bl[~small], bh[~small]
        if not len(al):
            break
        middle = (al + ah) // 2
        cut = np.full(len(al), -1)
        for look in range(LOOKS):
            waiting = np.flatnonzero(cut < 0)
            at = middle[waiting] + ((look + 1) // 2) * (1 if look % 2 else -1)
            waiting, at = waiting[(at >= al[waiting]) & (at < ah[waiting])], at[(at >= al[waiting]) & (at < ah[waiting])]
            place = np.searchsorted(b, a[at])
            cut[waiting[b[place] == a[at]]] = at[b[place] == a[at]]
        waiting = np.flatnonzero(cut < 0)
        if len(waiting):
            at, owner = _inside(al[waiting], ah[waiting])
            hit = b[np.searchsorted(b, a[at])] == a[at]
            owner, at = owner[hit], at[hit]
            order = np.lexsort((at, np.abs(at - middle[waiting][owner]), owner))
            nearest = order[np.diff(owner[order], prepend=-1) > 0]
            cut[waiting[owner[nearest]]] = at[nearest]
        done = cut >= 0
        cut, al, ah, bl, bh = cut[done], al[done], ah[done], bl[done], bh[done]
        place = np.searchsorted(b, a[cut])
        found_a.append(cut)
        found_b.append(place)
        al, ah = np.concatenate((al, cut + 1)), np.concatenate((cut, ah))
        bl, bh = np.concatenate((bl, place + 1)), np.concatenate((place, bh))
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


class Aligned:
    """A block of texts' tokens, one text after the other, and where they are cut; `sizes` are the
    bytes of each token of A and B."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        self.a_ends, self.b_ends = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
        filled = n_a > 0
        stops = np.cumsum(n_a)[filled] - 1, np.cumsum(n_b)[filled] - 1
        self.cut_a, self.cut_b = common_ends(self.a_ends, self.b_ends, *stops)

    def n_groups(self) -> np.ndarray:
        upto = np.searchsorted(self.cut_a, np.cumsum(self.n_a))
        return np.diff(upto, prepend=0)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, A place, B place) of all links: each token end of A with the B token it lies in,
        each further token end of B with the A token it lies in."""
        inside = np.ones(len(self.b), dtype=bool)
        inside[self.cut_b] = False
        further = np.flatnonzero(inside)
        a = np.concatenate((np.arange(len(self.a)), np.searchsorted(self.a_ends, self.b_ends[further])))
        b = np.concatenate((np.searchsorted(self.b_ends, self.a_ends), further))
        text = np.repeat(np.arange(len(self.n_a)), self.n_a)[a]
        return text, a, b

    def digests(self, tools: Encoder) -> list[str]:
        """The lower-case hex SHA-256 of each text's groups, `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        group_a = np.searchsorted(self.cut_a, np.arange(len(self.a)))
        group_b = np.searchsorted(self.cut_b, np.arange(len(self.b)))
        before_a, before_b = np.append(0, self.cut_a + 1), np.append(0, self.cut_b + 1)
        written = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.cut_a], last_b[self.cut_b] = 1, 2
        written[np.arange(len(self.a)) + before_b[group_a]] = self.a * 3 + last_a
        written[np.arange(len(self.b)) + before_a[group_b + 1]] = self.b * 3 + last_b
        names, lengths = _names(max(len(tools.a_bytes), len(tools.b_bytes)))
        spelled = names[written].view(np.uint8)
        spelled = spelled[spelled != 0]
        upto = np.concatenate(([0], np.cumsum(lengths[written])))[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))].tolist()
        # The last mark of a text is left out.
        return [hashlib.sha256(spelled[low:high - 1]).hexdigest() if high > low else "" for low, high in zip(upto, upto[1:])]


@lru_cache(maxsize=4)
def _names(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id in decimal with the mark that follows it, within a side, between sides or between
    groups, and its length."""
    names = [f"{number}{mark}".encode() for number in range(count) for mark in ",|;"]
    return np.array(names), np.array([len(x) for x in names], np.int64)


def _encoded(tools: Encoder, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts by A and B and their numbers per text; none for a text that is not spelled again."""
    a = tools.a([" " + t if t else "" for t in texts])
    b = tools.b([t or "" for t in texts])
    spelled = [(" " + t).encode() if t else b"" for t in texts]
    # A byte-level vocabulary without a normalizer, which `quick` has been found to be, spells any text.
    sides = [(b, tools.b_bytes)] if tools.quick else [(a, tools.a_bytes), (b, tools.b_bytes)]
    for i, text in enumerate(spelled):
        if not text or any(b"".join(map(table.__getitem__, side[i])) != text for side, table in sides):
            a[i] = b[i] = []
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    flat = (np.concatenate([np.empty(0, np.int64), *(np.array(x, np.int64) for x in side if x)]) for side in (a, b))
    return *flat, n_a, n_b


def _some(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Rows of a batch in runs of about `limit` units of length."""
    import pyarrow.compute as pc

    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(length)))
    low = 0
    while low < len(length):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + limit, "right")) - 1)
        yield low, high
        low = high


def _packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The ids of each text as one binary value, 32 bits each."""
    ends = np.concatenate(([0], np.cumsum(counts))) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<i4"))]).cast(pa.binary())


def _unpacked(token_sizes: tuple[np.ndarray, np.ndarray], a: pa.Array, b: pa.Array) -> Aligned:
    sides = [(np.frombuffer(b"".join(x.as_buffer() for x in side), "<i4").astype(np.int64),
              np.array([x.as_buffer().size // 4 for x in side], np.int64)) for side in (a, b)]
    return Aligned(token_sizes, sides[0][0], sides[1][0], sides[0][1], sides[1][1])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 32 | b


class PairSums:
    """How often each id pair is linked, over the texts of a task so far."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, found: Aligned) -> None:
        _, a, b = found.links()
        key, count = np.unique(_pair(found.a[a], found.b[b]), return_counts=True)
        self.keys.append(key)
        self.counts.append(count)
        self.held += len(key)
        if self.held > PAIRS:
            self._sum()

    def _sum(self) -> None:
        key, place = np.unique(np.concatenate(self.keys), return_inverse=True)
        count = np.zeros(len(key), np.int64)
        np.add.at(count, place, np.concatenate(self.counts))
        self.keys, self.counts, self.held = [key], [count], len(key)

    def taken(self) -> tuple[bytes, bytes]:
        self._sum()
        key, count = self.keys[0], self.counts[0]
        self.__init__()
        return key.tobytes(), count.tobytes()


_TOKENS = ("id long, a binary, b binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs binary, counts binary")


def _tokens(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """For each text its id, packed ids of both sides, and what its own tokens tell; besides, rows
    with the summed id pairs of some texts of a task, for which all of that is NULL."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, sums = encoder(*paths), PairSums()
        names = [f.split()[0] for f in _TOKENS.split(", ")]
        kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]

        def summed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, kind) for kind in kinds[:-2]), *(pa.array([x], pa.binary()) for x in sums.taken())], names=names)

        for batch in batches:
            for low, high in _some(batch.column("text")):
                texts = batch.column("text").slice(low, high - low).to_pylist()
                found = Aligned((tools.a_sizes, tools.b_sizes), *_encoded(tools, texts))
                groups = found.n_groups()
                sums.add(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(low, high - low), _packed(found.a, found.n_a), _packed(found.b, found.n_b),
                     *(pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, groups, found.n_a + found.n_b - groups)),
                     pa.array(found.digests(tools)), pa.nulls(high - low, pa.binary()), pa.nulls(high - low, pa.binary())], names=names)
                if sums.held > PAIRS // 2:
                    yield summed()
        if sums.held:
            yield summed()

    return docs.mapInArrow(task, _TOKENS)


def pair_counts(tokens: DataFrame) -> DataFrame:
    """(pair, n): in how many links of all texts each id pair is; the A id is in the upper 32 bits."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, count in zip(batch.column("pairs"), batch.column("counts")):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (key, count)], names=["pair", "n"])

    packed = tokens.where("pairs IS NOT NULL").select("pairs", "counts")
    return packed.mapInArrow(task, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _head(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs in ascending order and their counts, at most HEAD.

    How many pairs reach which power of two is counted first, so the bound holds before any pair
    is sent to the driver.
    """
    reach = F.floor(F.log2("n")).cast("int").alias("reach")
    sizes = {r.reach: r["count"] for r in pairs.groupBy(reach).count().collect()}
    least, total = 64, 0
    for power in sorted(sizes, reverse=True):
        total += sizes[power]
        if total > HEAD:
            break
        least = power
    most = pairs.where(F.log2("n") >= least).toArrow()
    pair, n = np.asarray(most["pair"]), np.asarray(most["n"])
    order = np.argsort(pair)
    return pair[order], n[order]


def _scores(tokens: DataFrame, sizes: tuple[np.ndarray, np.ndarray], pair: np.ndarray, n: np.ndarray, best: np.ndarray) -> DataFrame:
    """What the known pairs give each text, and its links of other pairs."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _some(batch.column("a"), 2 * BLOCK):
                some = batch.slice(low, high - low)
                found = _unpacked(sizes, some.column("a"), some.column("b"))
                text, a, b = found.links()
                b_id = found.b[b]
                key = _pair(found.a[a], b_id)
                place = np.searchsorted(pair, key)
                known = place < len(pair)
                known[known] = pair[place[known]] == key[known]
                count = np.zeros(len(key), np.int64)
                count[known] = n[place[known]]
                sums = np.zeros(some.num_rows, np.int64)
                np.add.at(sums, text, count)
                top = np.bincount(text[known & (count == best[b_id])], minlength=some.num_rows)
                order = np.lexsort((key[~known], text[~known]))
                rest, owner = key[~known][order], text[~known][order]
                ends = np.searchsorted(owner, np.arange(some.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [some.column("row"), pa.array(top, pa.int64()), pa.array(sums),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(rest, pa.int64()))],
                    names=["row", "n_best", "count_sum", "rest"])

    return tokens.select("row", "a", "b").mapInArrow(task, "row long, n_best long, count_sum long, rest array<long>")


def alignments(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The groups of each text: doc_id, byte_ends in blank and text, a_ends and b_ends (numbers of
    tokens up to each cut), a_ids and b_ids; empty lists for a text without tokens."""
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = encoder(a_path, b_path)
        for batch in batches:
            for low, high in _some(batch.column("text")):
                found = Aligned((tools.a_sizes, tools.b_sizes), *_encoded(tools, batch.column("text").slice(low, high - low).to_pylist()))
                ends = [np.concatenate(([0], np.cumsum(x))) for x in (found.n_groups(), found.n_a, found.n_b)]
                groups = found.n_groups()
                bytes_before = np.concatenate(([0], found.a_ends))[ends[1][:-1]]
                lists = [(found.a_ends[found.cut_a] - np.repeat(bytes_before, groups), ends[0]),
                         (found.cut_a + 1 - np.repeat(ends[1][:-1], groups), ends[0]),
                         (found.cut_b + 1 - np.repeat(ends[2][:-1], groups), ends[0]),
                         (found.a, ends[1]), (found.b, ends[2])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(low, high - low),
                     *(pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v, pa.int64())) for v, e in lists)],
                    names=["doc_id", "byte_ends", "a_ends", "b_ends", "a_ids", "b_ids"])

    return given.mapInArrow(task, "doc_id long, byte_ends array<long>, a_ends array<long>, b_ends array<long>, "
                                  "a_ids array<long>, b_ids array<long>")


def aligned_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    given = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    made = stored(_tokens(given, (a_path, b_path)).withColumn("row", F.monotonically_increasing_id()), "tokens")
    tokens, pairs = made.where("a IS NOT NULL"), stored(pair_counts(made), "pairs")
    pair, n = _head(pairs)
    # One count per B id: as many as the vocabulary has.
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = pairs.groupBy(b_id.alias("b")).agg(F.max("n").alias("best")).toArrow()
    best = np.zeros(int(np.asarray(highest["b"]).max(initial=-1)) + 1, np.int64)
    best[np.asarray(highest["b"])] = np.asarray(highest["best"])
    tools = encoder(a_path, b_path)
    scores = stored(_scores(tokens, (tools.a_sizes, tools.b_sizes), pair, n, best), "scores")

    top = pairs.groupBy(b_id.alias("b")).agg(F.max("n").alias("best"))
    rest = (
        scores.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
        .join(pairs, "pair").withColumn("b", b_id).join(top, "b")
        .groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                            F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    )
    own = tokens.select("row", F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return (
        own.join(scores.select("row", "n_best", "count_sum"), "row").join(rest, "row", "left")
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links",
                (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
    )
