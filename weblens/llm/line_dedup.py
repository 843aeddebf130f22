"""Blocks of lines that a document shares with an earlier one, found and cut out.

Overlapping documents meet through rare line hashes. A line is made rare rather than chosen to be:
a line of fewer than `least_words` words is joined with the lines after it until that many are
reached, so that a short line of boilerplate pairs no documents, while a hash that thousands of
copies share is not lost by a cap on its frequency. Of all holders of a hash the earliest is the
partner of each other one; no pairs are formed within a group. Each pair is aligned with patience
diff: unique common lines in their longest increasing order anchor the alignment, between anchors
it goes on recursively, and equal lines at the edges are taken along. A run of aligned lines with
`least_words` words or more is deleted from the later document, and so is the whole document if
all its lines are aligned. Blocks that stand in another order escape an alignment; where a hash
that made the pair is not in a deleted run, the run around it is grown from it.

Earlier is the smaller (doc_id, text); a NULL doc_id comes last. Result: every line that belongs to
a shortest run of `least_words` words which an earlier document holds as well is deleted, and with
it the lines next to the run that the partner has in the same places; no other line is.

Cases: a NULL or blank text has no lines and stays as it is. A text with fewer words altogether
is compared as a whole. Lines are compared without blanks at their ends; blank lines belong to no
block and stay. Equal rows (same doc_id and text) are one document: none of them is cut for the
others. Repeated blocks within one document stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weblens.llm.store import again, stored
from weblens.llm.text import Block, blocks, mix, shingles, signed, span_hashes

LEAST_WORDS = 20
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _lines(block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text of a block its row, and of its lines with a word: hashes, words, numbers."""
    starts, ends, _ = block.words()
    line_starts, line_ends, at = block.words(_NOT_NEWLINE)
    first, stop = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    filled = stop > first
    hashes = np.zeros(len(line_starts), np.uint64)
    if filled.any():
        hashes[filled] = span_hashes(block.data, starts[first[filled]], ends[stop[filled] - 1])
    newlines = np.concatenate(([0], np.cumsum(block.data == 10)))
    for i in range(block.stop - block.first):
        mine = np.arange(at[i], at[i + 1])[filled[at[i]:at[i + 1]]]
        number = newlines[line_starts[mine]] - newlines[block.offsets[i]]
        yield block.first + i, hashes[mine], (stop - first)[mine], number


def run_hashes(hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, line after the last, hash) of the shortest run from each line on that has
    `least` words; of all lines if they have fewer together."""
    if not len(hashes):
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.uint64)
    upto = np.concatenate(([0], np.cumsum(words)))
    stop = np.searchsorted(upto, upto[:-1] + least)
    first = np.flatnonzero(stop <= len(hashes))
    if not len(first):
        return np.array([0]), np.array([len(hashes)]), shingles(hashes, len(hashes))
    stop = stop[first]
    out = np.empty(len(first), np.uint64)
    for size in np.unique(stop - first):
        k = np.flatnonzero(stop - first == size)
        out[k] = shingles(hashes, int(size))[first[k]]
    return first, stop, out


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: pairs (i, j) of aligned lines, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        once_b: dict[int, int] = {}
        for j in range(b0, b1):
            once_b[b[j]] = -1 if b[j] in once_b else j
        once_a: dict[int, int] = {}
        for i in range(a0, a1):
            once_a[a[i]] = -1 if a[i] in once_a else i
        common = [(i, once_b[v]) for v, i in once_a.items() if i >= 0 and once_b.get(v, -1) >= 0]
        common.sort()
        # Piles of patience sorting: the top cards, and for each card the top of the pile before.
        tops: list[int] = []
        cards: list[int] = []
        before: list[int] = []
        for n, (_, j) in enumerate(common):
            pile = bisect_left(tops, j)
            before.append(cards[pile - 1] if pile else -1)
            if pile == len(tops):
                tops.append(j)
                cards.append(n)
            else:
                tops[pile], cards[pile] = j, n
        chain = []
        n = cards[-1] if cards else -1
        while n >= 0:
            chain.append(common[n])
            n = before[n]
        low_a, low_b = a0, b0
        for i, j in [*reversed(chain), (a1, b1)] if chain else []:
            if i > low_a and j > low_b:
                todo.append((low_a, i, low_b, j))
            if i < a1:
                out.append((i, j))
            low_a, low_b = i + 1, j + 1
    return sorted(out)


def common_blocks(
    later: list[int], words: list[int], earlier: list[int], runs: list[tuple[int, int]], least: int
) -> set[int]:
    """Numbers of the later document's lines in aligned runs of at least `least` words.

    `runs` are those of its runs through which the two met.
    """
    cut: set[int] = set()

    def take(i0: int, i1: int) -> None:
        if sum(words[i0:i1]) >= least or i1 - i0 == len(later):
            cut.update(range(i0, i1))

    pairs = align(later, earlier)
    begin = 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k][0] != pairs[k - 1][0] + 1 or pairs[k][1] != pairs[k - 1][1] + 1:
            take(pairs[begin][0], pairs[k - 1][0] + 1)
            begin = k
    places: dict[int, list[int]] = {}
    for j, value in enumerate(earlier):
        places.setdefault(value, []).append(j)
    for i0, i1 in runs:
        if not cut.issuperset(range(i0, i1)):
            for j in places.get(later[i0], ()):
                if later[i0:i1] == earlier[j:j + i1 - i0]:
                    low, high, shift = i0, i1, j - i0
                    while low and low + shift and later[low - 1] == earlier[low + shift - 1]:
                        low -= 1
                    while high < len(later) and high + shift < len(earlier) and later[high] == earlier[high + shift]:
                        high += 1
                    take(low, high)
                    break
    return cut


def _documents(docs: DataFrame, least: int) -> DataFrame:
    """(rank, doc, lines, words, numbers, runs): one row per different document with lines.

    `rank` orders documents, `doc` is its hash; runs are structs (hash, first, stop).
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind))

        for batch in batches:
            for block in blocks(batch.column("text"), 1 << 22):
                rows, lines, words, numbers, first, stop, runs = ([] for _ in range(7))
                for row, h, w, n in _lines(block):
                    if len(h):
                        f, s, r = run_hashes(h, w, least)
                        for kept, value in zip((rows, lines, words, numbers, first, stop, runs), (row, signed(h), w, n, f, s, signed(r))):
                            kept.append(value)
                if rows:
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(take), batch.column("doc").take(take), lists(lines, pa.int64()),
                         *(lists([x.astype(np.int32) for x in p], pa.int32()) for p in (words, numbers, first, stop)),
                         lists(runs, pa.int64())],
                        ["doc_id", "doc", "lines", "words", "numbers", "first", "stop", "runs"])

    given = docs.select(F.col("doc_id").cast("long"), _identity().alias("doc"), F.col("text").cast("string"))
    return given.mapInArrow(
        task, "doc_id long, doc long, lines array<long>, words array<int>, numbers array<int>, first array<int>, "
              "stop array<int>, runs array<long>").withColumn("rank", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc"))


def _identity():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, numbers, partners): of each document with repeated blocks the numbers of the lines to
    delete, counted from 0, and the ids of the earlier documents that hold them."""
    known = stored(_documents(docs, least_words), "lines")
    runs = known.select("rank", "doc", F.explode(F.arrays_zip("runs", "first", "stop")).alias("r")).select(
        "rank", "doc", F.col("r.runs").alias("run"), F.col("r.first").alias("first"), F.col("r.stop").alias("stop"))
    holder = runs.groupBy("run").agg(F.min("rank").alias("holder"), F.max("rank").alias("other")).where("holder != other")
    met = (
        runs.withColumn("key", again("run")).join(holder.select(again("run").alias("key"), "holder"), "key")
        .where("doc != holder.doc")
        .groupBy("doc", F.col("holder.doc").alias("partner")).agg(F.array_sort(F.collect_set(F.struct("first", "stop"))).alias("met"))
    )
    once = known.groupBy("doc").agg(*(F.first(c).alias(c) for c in ("doc_id", "lines", "words", "numbers")))
    once = stored(once, "different")
    joined = (
        met.join(once.select(F.col("doc").alias("partner"), F.col("doc_id").alias("partner_id"), F.col("lines").alias("earlier")), "partner")
        .join(once.select("doc", "lines", "words", "numbers"), "doc")
        .select("doc", "partner_id", "met", "lines", "words", "numbers", "earlier")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            given = batch.select(["met", "lines", "words", "numbers", "earlier"])
            # A few rows at a time: as Python objects a whole batch takes many times its own memory.
            for at in range(0, given.num_rows, 16):
                for row in given.slice(at, 16).to_pylist():
                    found = common_blocks(
                        row["lines"], row["words"], row["earlier"], [(r["first"], r["stop"]) for r in row["met"]],
                        least_words)
                    out.append(sorted(row["numbers"][i] for i in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("partner_id"), pa.array(out, pa.list_(pa.int32()))],
                ["doc", "partner_id", "numbers"])

    cuts = joined.mapInArrow(task, "doc long, partner_id long, numbers array<int>").where("size(numbers) > 0")
    # A document's rows here are at most its own runs.
    return cuts.groupBy("doc").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("numbers"),
        F.array_sort(F.collect_set("partner_id")).alias("partners"))


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` with text free of blocks that an earlier document holds, and deleted_lines (the
    numbers of the lines cut out) and partners (the ids of the earlier documents)."""
    given = [c for c in docs.columns if c not in ("deleted_lines", "partners")]
    cuts = stored(repeated_lines(docs, least_words), "cuts")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in given)).alias("row"), _identity().alias("doc"))
    # Dealt out at every size: a table of cuts grows with the documents and is never broadcast.
    joined = keyed.join(cuts.hint("merge"), "doc", "left")
    kept = F.filter(F.split("row.text", "\n"), lambda line, i: ~F.array_contains(F.col("numbers"), i))
    text = F.when(F.col("numbers").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in given),
        F.coalesce("numbers", F.array().cast("array<int>")).alias("deleted_lines"),
        F.coalesce("partners", F.array().cast("array<long>")).alias("partners"))


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_deleted, deleted_lines, partners and the text that is left of each row."""
    cut = without_repeats(docs.select("doc_id", "text"))
    return cut.select("doc_id", F.size("deleted_lines").cast("long").alias("n_deleted"), "deleted_lines", "partners", "text")
