"""Quality rules on whole documents: counts first, then a labelling of the lines.

A linear-chain conditional random field labels each line as content or boilerplate from what the
line looks like and from its neighbours' labels; Viterbi decoding finds the best sequence, and
the share of words in content lines decides whether a document stays. The field is trained here,
by gradient ascent in numpy on all lines of a bounded sample of labelled documents; lines take the
document's label (quality 1: content).

Cases: NULL, empty and blank texts have no words and fail the base rules. Lines without a word
are no lines. Without labelled documents of both kinds every line counts as content. Repeated
labels of a document count as one, good if any of them is. Texts are read whole, however long. Equal
rows are judged alike; an empty table gives no rows. Further columns may have any name but those
added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from weblens.llm.text import IS_WORD, Block, blocks, mix, shingles, span_hashes, text_of

#: Labelled documents of each kind that are learned from.
LEARN = 500
#: Lines of a sequence that is learned from; a longer document is several.
SEQUENCE = 64
STEPS, RATE, DECAY = 200, 0.5, 1e-3
#: The least share of words in content lines.
CONTENT_SHARE = 0.5
LEAST_WORDS, MOST_REPEATED = 10, 20
CONTENT, BOILERPLATE = 0, 1
WINDOW = 5

_ANY = np.ones(256, bool)
_ANY[10] = False


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOLS = _table("#*$%&|<>")
_MARKS = _table("#*$%&|<>{}[]=_~^\\/@")
_DIGITS = _table("0123456789")
_CAPITALS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ENDINGS = _table(".!?:;")
_LOUD = _table("!?")
_STARTS_CHAR = np.ones(256, bool)
_STARTS_CHAR[0x80:0xC0] = False

FEATURES = (
    "always", "words 1-2", "words 3-5", "words 6-15", "words over 15", "ends a sentence", "marks over 3 %",
    "marks over 10 %", "bars", "digits over 20 %", "capitals over 40 %", "loud over 3 %", "long words", "seen before", "first", "last",
)


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


@dataclass
class Measured:
    """A block's counts per text, and its lines: features, words, where each text's begin."""

    counts: np.ndarray  # n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    features: np.ndarray
    line_words: np.ndarray
    at: np.ndarray


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs more than once, and whether it is not the first of its kind."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    later = np.zeros(len(keys), bool)
    more = np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    more[order[1:][same]] = more[order[:-1][same]] = True
    return more, later


def measure(block: Block) -> Measured:
    data, texts = block.data, block.stop - block.first
    starts, ends, at = block.words()
    owner = np.repeat(np.arange(texts), np.diff(at))

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(_sums(flags)[block.offsets])

    words = span_hashes(data, starts, ends)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= WINDOW:
        runs = shingles(words, WINDOW)
        inside = np.flatnonzero(owner[:len(runs)] == owner[WINDOW - 1:])
        more, _ = _repeated(mix(runs[inside] ^ (owner[inside].astype(np.uint64) << np.uint64(32))))
        hit = inside[more]
        np.add.at(covered, hit, 1)
        np.subtract.at(covered, hit + WINDOW, 1)
    in_repeat = np.cumsum(covered)[:len(words)] > 0

    line_starts, line_ends, line_at = block.words(_ANY)
    n_words = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    keep = n_words > 0
    line_owner = np.repeat(np.arange(texts), np.diff(line_at))[keep]
    line_starts, line_ends, n_words = line_starts[keep], line_ends[keep], n_words[keep]
    hashes = span_hashes(data, line_starts, line_ends)
    _, later = _repeated(mix(hashes ^ (line_owner.astype(np.uint64) << np.uint64(32))))
    first_line = np.searchsorted(line_owner, np.arange(texts + 1))

    def per_line(table: np.ndarray) -> np.ndarray:
        sums = _sums(table[data])
        return sums[line_ends] - sums[line_starts]

    chars = np.maximum(per_line(IS_WORD & _STARTS_CHAR), 1)
    last_word = ends[np.maximum(np.searchsorted(starts, line_ends) - 1, 0)] - 1 if len(line_ends) else line_ends
    marks, loud = per_line(_MARKS), per_line(_LOUD)
    position = np.arange(len(line_owner))
    columns = [
        np.ones(len(n_words), bool), n_words <= 2, (n_words > 2) & (n_words <= 5), (n_words > 5) & (n_words <= 15),
        n_words > 15, _ENDINGS[data[last_word]] if len(last_word) else np.zeros(0, bool), marks > 0.03 * chars,
        marks > 0.1 * chars, per_line(_table("|")) >= 2, per_line(_DIGITS) > 0.2 * chars,
        per_line(_CAPITALS) > 0.4 * chars, loud > 0.03 * chars, chars > 12 * n_words, later,
        position == first_line[:-1][line_owner], position == first_line[1:][line_owner] - 1,
    ]
    counts = np.stack([
        np.diff(at), per_text(IS_WORD[data] & _STARTS_CHAR[data]), per_text(_SYMBOLS[data]),
        np.diff(_sums(later)[first_line]), np.diff(_sums(in_repeat)[at]),
    ])
    return Measured(counts, np.stack(columns, axis=1).astype(np.float32), n_words, first_line)


@dataclass
class Field:
    """A linear-chain conditional random field with two labels: weights of features and of steps."""

    emission: np.ndarray
    transition: np.ndarray

    def best(self, scores: list[list[float]]) -> list[int]:
        """The most likely labels of a sequence, by Viterbi decoding, from its emission scores."""
        (t00, t01), (t10, t11) = self.transition.tolist()
        a, b = scores[0]
        back: list[tuple[int, int]] = []
        for x, y in scores[1:]:
            from_a, from_b = (0, a + t00) if a + t00 >= b + t10 else (1, b + t10), (0, a + t01) if a + t01 >= b + t11 else (1, b + t11)
            back.append((from_a[0], from_b[0]))
            a, b = from_a[1] + x, from_b[1] + y
        label = CONTENT if a >= b else BOILERPLATE
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(sequences: list[np.ndarray], labels: list[int]) -> Field:
    """Fit a field to the line features of documents, all lines of one having its label.

    Marginals come from the forward and the backward pass over all sequences at once.
    """
    # Kinds and documents count alike, whatever their numbers and lengths.
    documents = np.array([1 / labels.count(k) for k in labels]) / 2 / np.array([len(s) for s in sequences])
    cut = [(s[at:at + SEQUENCE], k, w) for s, k, w in zip(sequences, labels, documents) for at in range(0, len(s), SEQUENCE)]
    sequences, labels, share = [c[0] for c in cut], [c[1] for c in cut], np.array([c[2] for c in cut])
    longest = max(map(len, sequences))
    x = np.zeros((len(sequences), longest, len(FEATURES)))
    there = np.zeros((len(sequences), longest), bool)
    for i, s in enumerate(sequences):
        x[i, :len(s)], there[i, :len(s)] = s, True
    gold = np.eye(2)[np.array(labels)][:, None, :] * there[..., None]
    emission, transition = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    pairs = (there[:, 1:] & there[:, :-1])[..., None, None]
    gold_pairs = gold[:, :-1, :, None] * gold[:, 1:, None, :]
    for step in range(STEPS):
        scores = x @ emission
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, longest):
            moved = _logsum(forward[:, t - 1, :, None] + transition, 1) + scores[:, t]
            forward[:, t] = np.where(there[:, t, None], moved, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            moved = _logsum(transition + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(there[:, t + 1, None], moved, 0.0)
        total = _logsum(forward[:, -1], 1)[:, None]
        single = np.exp(forward + backward - total[..., None]) * there[..., None]
        double = np.exp(forward[:, :-1, :, None] + transition + (scores + backward)[:, 1:, None, :] - total[..., None, None]) * pairs
        up = np.einsum("i,itf,itk->fk", share, x, gold - single)
        across = np.einsum("i,itkl->kl", share, gold_pairs - double)
        rate = RATE * (1 - step / STEPS) * 10
        emission += rate * (up - DECAY * emission)
        transition += rate * (across - DECAY * transition)
    return Field(emission, transition)


def fit(docs: DataFrame, labels: DataFrame) -> Field | None:
    """A field from documents with a quality label; None unless there are some of both kinds.

    The labelled documents with the least hashes are learned from, LEARN of each kind.
    """
    ids = []
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("quality").cast("int").alias("quality"))
    for kind in (0, 1):
        ids += known.where(F.col("quality") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARN).collect()
    if len({r.quality for r in ids}) < 2:
        return None
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, quality int")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for block in blocks(batch.column("text")):
                m = measure(block)
                for low, high in zip(m.at[:-1], m.at[1:]):
                    out.append(np.packbits(m.features[low:high].astype(bool), axis=1).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(out, pa.binary())], ["doc_id", "quality", "lines"])

    rows = sorted(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "quality", "text").mapInArrow(lines, "doc_id long, quality int, lines binary")
        .where("octet_length(lines) > 0").groupBy("doc_id").agg(F.min("lines").alias("lines"), F.min("quality").alias("quality")).collect())
    if len({r.quality for r in rows}) < 2:
        return None
    sequences = [
        np.unpackbits(np.frombuffer(r.lines, np.uint8).reshape(-1, 2), axis=1)[:, :len(FEATURES)].astype(float) for r in rows]
    return train(sequences, [CONTENT if r.quality else BOILERPLATE for r in rows])


ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " \
        "content_share double, base_failed boolean, kept boolean"


def judge(docs: DataFrame, field: Field | None, least_share: float = CONTENT_SHARE) -> DataFrame:
    """`docs` with counts, content_share, base_failed and kept; like-named columns are replaced."""
    added = T.StructType.fromDDL(ADDED)
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in added.names)).alias("row"))
    schema = T.StructType([given.schema["row"], *added.fields])
    names = schema.names

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((5, len(batch)), np.int64)
            share = np.zeros(len(batch))
            for block in blocks(text_of(batch)):
                m = measure(block)
                counts[:, block.first:block.stop] = m.counts
                scores = (m.features @ field.emission).tolist() if field else None
                words = m.line_words.tolist()
                for i, (low, high) in enumerate(zip(m.at[:-1].tolist(), m.at[1:].tolist())):
                    if high > low:
                        labels = field.best(scores[low:high]) if scores else [CONTENT] * (high - low)
                        good = sum(w for w, label in zip(words[low:high], labels) if label == CONTENT)
                        share[block.first + i] = good / sum(words[low:high])
            failed = (counts[0] < LEAST_WORDS) | (100 * counts[4] > MOST_REPEATED * counts[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *map(pa.array, counts), pa.array(share), pa.array(failed),
                 pa.array(~failed & (share >= least_share))], names=names)

    return given.mapInArrow(task, schema).select("row.*", *added.names)


def judged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, content_share, base_failed and kept of each row."""
    return judge(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
