"""Documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

The method is set-relation skipping. Sets that are equal count once. An inverted index over the
rarest n-grams of each set (its prefix) yields candidates; sets already known to be very similar
to a leading set stand in the index as one block with the range of their sizes and positions, so
a whole block is skipped when neither size nor position allows a link. What is known of a leader
then answers for its block: with d = 1 - similarity, a metric, a member can only be linked to
something within `1 - threshold + d(member, leader)` of the leader. Members are looked at one by
one only where that leaves the answer open. The result is exact up to 64-bit hash collisions.

Cases: NULL, empty or blank text has no n-grams and is linked with nothing. With fewer than n
words the whole sequence is the one n-gram. Repeated rows are linked by their equal sets. A NULL
doc_id takes part; a component is named by its least doc_id that is not NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from weblens.llm.graph import components
from weblens.llm.store import again, bit_table, row_hash, stored
from weblens.llm.text import Block, blocks, distinct, mix, shingle_sets, signed

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: How often n-grams occur is counted in 2**SLOT_BITS slots, dealt out in 2**PART_BITS parts. An
#: n-gram is marked as common if its slot holds COMMON more than slots hold by chance. The marks
#: decide the order in the index and so the speed, never the result.
SLOT_BITS, PART_BITS, COMMON = 27, 8, 8
#: Bits of the table of wanted sets.
TABLE_BITS = 22
#: N-grams with the least hashes of a set, which look for a leader.
LEADING = 8
#: Leaders that a set may find through one n-gram.
CLASSES = 4
_BUFFER = 1 << 21


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for block in blocks(column):
        yield from shingle_sets(Block(block.first, block.stop, LOWER[block.data], block.offsets), n)


def _node(grams: np.ndarray) -> int:
    """One hash for a set: of its size, the sum and the mixed sum of its members."""
    with np.errstate(over="ignore"):
        parts = np.array([len(grams), grams.sum(), mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64)
        folded = mix(mix(mix(parts[:1]) + parts[1:2]) + parts[2:3])
    return int(signed(folded)[0])


def _needed(size: int, percent: int) -> int:
    return (percent * size + 99) // 100


def _packed(slots: np.ndarray) -> bytes:
    """Ascending numbers as steps of a byte each; 255 is a step that goes on in the next byte."""
    steps = np.diff(slots, prepend=slots.dtype.type(0)).astype(np.int64)
    more = steps // 255
    out = np.full(len(steps) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = steps - 255 * more
    return out.tobytes()


def _unpacked(steps: bytes | pa.Buffer) -> np.ndarray:
    read = np.frombuffer(steps, np.uint8)
    return np.cumsum(read, dtype=np.int64)[read != 255]


def _documents(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, n_shingles, node) per row, and (part, slots): which slots n-grams fall in."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        held = 0
        names = ["kind", "rid", "doc_id", "n", "node", "slots"]

        def slots() -> pa.RecordBatch:
            found = np.sort((np.concatenate(kept) >> np.uint64(64 - SLOT_BITS)).astype(np.uint32))
            kept.clear()
            width = 1 << (SLOT_BITS - PART_BITS)
            at = np.searchsorted(found, np.arange((1 << PART_BITS) + 1, dtype=np.int64) * width)
            parts = [k for k in range(1 << PART_BITS) if at[k] < at[k + 1]]
            made = [_packed(found[at[k]:at[k + 1]] - np.uint32(k * width)) for k in parts]
            none = pa.nulls(len(parts), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(parts), np.int32)), none, none, pa.array(parts, pa.int64()), none, pa.array(made, pa.binary())], names)

        for batch in batches:
            sizes = np.zeros(len(batch), np.int64)
            nodes: list[int | None] = [None] * len(batch)
            for i, grams in _sets(batch.column("text"), n):
                sizes[i] = len(grams)
                if len(grams):
                    nodes[i] = _node(grams)
                    kept.append(grams)
                    held += len(grams)
                    if held >= _BUFFER:
                        yield slots()
                        held = 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(batch), np.int32)), batch.column("rid"), batch.column("doc_id"),
                 pa.array(sizes), pa.array(nodes, pa.int64()), pa.nulls(len(batch), pa.binary())], names)
        if kept:
            yield slots()

    given = docs.select(row_hash(docs).alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    both = stored(
        given.mapInArrow(task, "kind int, rid long, doc_id long, n long, node long, slots binary"), "sets", "kind")
    rows = both.where("kind = 0").select("rid", "doc_id", F.col("n").alias("n_shingles"), "node")
    return rows, both.where("kind = 1").select(F.col("n").alias("part"), "slots")


def _common(slots: DataFrame, total: int) -> bytes:
    """The table of common n-grams, 2**SLOT_BITS bits.

    Of `total` n-grams some fall in one slot by chance; what exceeds that mean and its spread by
    COMMON marks a slot. Each part is counted by one task in an array of fixed size.
    """
    mean = total / (1 << SLOT_BITS)
    least = int(mean + 4 * mean ** 0.5 + COMMON)
    width = 1 << (SLOT_BITS - PART_BITS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        now = -1

        def finished(part: int) -> pa.RecordBatch:
            marks = np.packbits(counts.pop(part) >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([marks], pa.binary())], ["part", "marks"])

        for batch in batches:
            for part, found in zip(batch.column("part").to_pylist(), batch.column("slots")):
                if part != now and now in counts:
                    yield finished(now)
                now = part
                each = counts.setdefault(part, np.zeros(width, np.int64))
                np.add.at(each, _unpacked(found.as_buffer()), 1)
        if now in counts:
            yield finished(now)

    counted = slots.repartition("part").sortWithinPartitions("part").mapInArrow(task, "part long, marks binary")
    table = bytearray(1 << (SLOT_BITS - 3))
    for row in counted.collect():  # 2**PART_BITS rows of fixed size
        table[row.part * width // 8:(row.part + 1) * width // 8] = row.marks
    return bytes(table)


def _index(docs: DataFrame, n: int, percent: int, table: Broadcast) -> DataFrame:
    """(node, n, rare, least, grams): of each set how many n-grams are rare, the n-grams with the
    least hashes, and the prefix, rare n-grams first."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            nodes, sizes, rares, leasts, fronts = [], [], [], [], []
            for _, grams in _sets(batch.column("text"), n):
                if not len(grams):
                    continue
                common = _is_common(bits, grams)
                front = len(grams) - _needed(len(grams), percent) + 1
                rares.append(int((~common).sum()))
                leasts.append(signed(grams[:LEADING]))
                rare = grams[~common][:front]
                fronts.append(rare if len(rare) == front else np.concatenate((rare, grams[common][:front - len(rare)])))
                nodes.append(_node(grams))
                sizes.append(len(grams))

            def lists(parts: list[np.ndarray]) -> pa.Array:
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rares, pa.int64()), lists(leasts), lists(fronts)],
                ["node", "n", "rare", "least", "grams"])

    fronts = docs.select(F.col("text").cast("string")).mapInArrow(
        task, "node long, n long, rare long, least array<long>, grams array<long>")
    return stored(fronts.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "rare", "least", "grams"))), "index")


def _marked_nodes(pairs: DataFrame) -> bytes:
    """A bit table of fixed size that lets pass all nodes of `pairs` (a, b), and a few more."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    place = F.pmod(F.shiftrightunsigned("node", 20), F.lit(1 << TABLE_BITS))
    return bit_table(nodes, place, TABLE_BITS)


def _is_marked(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = (nodes.view(np.uint64) >> np.uint64(20)) % np.uint64(1 << TABLE_BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _is_common(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether n-grams are marked in the table of frequent ones."""
    at = grams >> np.uint64(64 - SLOT_BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _plausible(pairs: DataFrame, index: DataFrame, table: Broadcast) -> DataFrame:
    """`pairs` (a, b) with `least`, a bound from below for their distance, from prefixes alone.

    Up to where the shorter of both prefixes ends in the common order, what is shared is known;
    beyond, no more than what is left of either set can be.
    """
    wanted = _marked_nodes(pairs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(_is_marked(bits, np.asarray(batch.column("node")))))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)

        def ordered(grams: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            front = np.asarray(grams.values).view(np.uint64)
            return _is_common(bits, front).astype(np.uint8), front

        def up_to(common: np.ndarray, front: np.ndarray, end: tuple[int, int]) -> int:
            rare = int(np.searchsorted(common, 1))
            if end[0]:
                return rare + int(np.searchsorted(front[rare:], np.uint64(end[1]), "right"))
            return int(np.searchsorted(front[:rare], np.uint64(end[1]), "right"))

        for batch in batches:
            out = np.empty(len(batch))
            for i, (x, y, na, nb) in enumerate(zip(*(batch.column(k) for k in ("x", "y", "na", "nb")))):
                (cx, x), (cy, y), na, nb = ordered(x), ordered(y), na.as_py(), nb.as_py()
                end = min((int(cx[-1]), int(x[-1])), (int(cy[-1]), int(y[-1])))
                kx, ky = up_to(cx, x, end), up_to(cy, y, end)
                met = np.sort(np.concatenate((x[:kx], y[:ky])))
                most = int((met[1:] == met[:-1]).sum()) + min(na - kx, nb - ky)
                out[i] = 1 - most / (na + nb - most)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(out)], ["a", "b", "least"])

    fronts = index.select("node", "n", "grams")
    fronts = fronts.mapInArrow(task, fronts.schema)
    joined = (
        pairs.join(fronts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("grams").alias("x")), "a")
        .join(fronts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("y")), "b")
        .select("a", "b", "na", "nb", "x", "y")
    )
    return joined.mapInArrow(bound, "a long, b long, least double")


def _verified(docs: DataFrame, n: int, pairs: DataFrame) -> DataFrame:
    """`pairs` (a, b) with the size of both sets and of what they share (na, nb, shared).

    Sets are made again from the texts, only of nodes that occur in a pair: a bit table of fixed
    size lets pass all of these (and a few more), the joins are exact.
    """
    wanted = _marked_nodes(pairs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, np.uint8)
        for batch in batches:
            nodes, sets = [], []
            for _, grams in _sets(batch.column("text"), n):
                if len(grams):
                    node = _node(grams)
                    if _is_marked(bits, np.array([node]))[0]:
                        nodes.append(node)
                        sets.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "grams"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((3, len(batch)), np.int64)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                met = np.sort(np.concatenate((x, y)))
                out[:, i] = len(x), len(y), int((met[1:] == met[:-1]).sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), *map(pa.array, out)], ["a", "b", "na", "nb", "shared"])

    sets = (
        docs.select(F.col("text").cast("string")).mapInArrow(task, "node long, grams binary")
        .groupBy("node").agg(F.first("grams").alias("grams"))
    )
    sets = stored(sets, "whole-sets")
    # A pair brings the smaller number of sets along: the leader's set last.
    joined = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return joined.mapInArrow(compare, "a long, b long, na long, nb long, shared long")


def _distance():
    return 1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))


def _is_link(percent: int):
    return 100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))


def _leaders(index: DataFrame, percent: int) -> DataFrame:
    """(a, b): a set and one with which it shares at least half of its least n-grams.

    Of all sets with an n-gram those are asked that have the fewest rare n-grams, one of each
    class: the original of a group of edited copies has nothing that the copies lack. Sets that
    only have a passage in common share too little; what is missed is found through the index.
    """
    fronts = index.select("node", "n", "rare", F.explode("least").alias("gram"), F.size("least").alias("front"))
    kind = F.pmod(F.xxhash64("node"), F.lit(CLASSES))
    asked = F.array(*(F.min(F.when(kind == k, F.struct("rare", "node", "n"))) for k in range(CLASSES)))
    first = fronts.groupBy("gram").agg(asked.alias("asked"), F.count("*").alias("count")).where("count > 1")
    return (
        fronts.select(F.col("node").alias("a"), "n", "front", again("gram").alias("key"))
        .join(first.select(again("gram").alias("key"), F.explode("asked").alias("b")), "key")
        .where(F.col("a") != F.col("b.node"))
        .where(f"100 * n >= {percent} * b.n and 100 * b.n >= {percent} * n")
        .groupBy("a", F.col("b.node").alias("b"), "front").agg(F.count("*").alias("met"))
        .where("2 * met >= front").select("a", "b")
    )


def _entries(labelled: DataFrame) -> DataFrame:
    """The index by n-gram: (gram, g, c, low, high, rest), one row per block and batch.

    A block is what has the same leader g; low and high bound its sizes, rest is the most that
    follows the n-gram in any of its sets.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("grams")
            at = np.asarray(grams.offsets).astype(np.int64)
            lengths = np.diff(at)
            flat = np.asarray(grams.flatten())
            row = np.repeat(np.arange(len(batch)), lengths)
            position = np.arange(len(flat)) - np.repeat(at[:-1] - at[0], lengths)
            g, c, n = (np.asarray(batch.column(k))[row] for k in ("g", "c", "n"))
            order = np.lexsort((g, flat))
            flat, g, c, n, rest = flat[order], g[order], c[order], n[order], (n - position - 1)[order]
            new = np.concatenate(([True], (flat[1:] != flat[:-1]) | (g[1:] != g[:-1]))) if len(flat) else np.empty(0, bool)
            begin = np.flatnonzero(new)
            if not len(begin):
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[begin]), pa.array(g[begin]), pa.array(c[begin]),
                 *(pa.array(f.reduceat(v, begin)) for f, v in ((np.minimum, n), (np.maximum, n), (np.maximum, rest)))],
                ["gram", "g", "c", "low", "high", "rest"])

    return labelled.select("grams", "g", "c", "n").mapInArrow(
        task, "gram long, g long, c long, low long, high long, rest long")


def _candidates(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): leaders of blocks that may hold linked sets and are in different components."""
    names = ["gram", "g", "c", "low", "high", "rest"]

    def pairs_of(e: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Numbers k for which the entries i[k] and j[k] may be linked."""
        low, high, rest = e["low"], e["high"], e["rest"]
        good = (e["c"][i] != e["c"][j]) & (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        good &= (100 + percent) * (1 + np.minimum(rest[i], rest[j])) >= percent * (low[i] + low[j])
        return np.flatnonzero(good)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.empty(0, np.int64) for k in names}
        seen: set[tuple[int, int]] = set()

        def lists(e: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            gram = e["gram"]
            begin = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            size = np.diff(np.append(begin, len(gram)))
            two = begin[size == 2]
            yield two, two + 1
            for first, length in zip(begin[size > 2], size[size > 2]):
                # By size: beyond the last that is small enough, the rest of the list is skipped.
                order = first + np.argsort(e["low"][first:first + length], kind="stable")
                lows = e["low"][order]
                stop = np.searchsorted(percent * lows, 100 * e["high"][order], "right")
                for k in range(length - 1):
                    if stop[k] > k + 1:
                        others = order[k + 1:stop[k]]
                        yield np.full(len(others), order[k]), others

        def found(e: dict[str, np.ndarray]) -> pa.RecordBatch:
            fresh = []
            for i, j in lists(e):
                keep = pairs_of(e, i, j)
                for a, b in zip(e["g"][i[keep]].tolist(), e["g"][j[keep]].tolist()):
                    pair = (a, b) if a < b else (b, a)
                    if a != b and pair not in seen:
                        seen.add(pair)
                        fresh.append(pair)
            if len(seen) > 200_000:  # only spares repeats: the rows are made distinct below
                seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in fresh], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            e = {k: np.concatenate((held[k], np.asarray(batch.column(k)))) for k in names}
            cut = int(np.searchsorted(e["gram"], e["gram"][-1]))  # the last list may go on
            held = {k: v[cut:] for k, v in e.items()}
            if cut:
                yield found({k: v[:cut] for k, v in e.items()})
        if len(held["gram"]):
            yield found(held)

    ordered = entries.repartition("gram").sortWithinPartitions("gram")
    return ordered.mapInArrow(task, "a long, b long").distinct()


def ngram_join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(rid, doc_id, n_shingles, node, root) for each row of `docs` (doc_id, text, ...).

    Two documents are linked when 100 * shared >= percent * united n-grams. Rows with one `root`
    are joined by a path of links. `node` stands for a set, `rid` for a row's content. Both
    `node` and `root` are NULL where there is no n-gram.
    """
    rows, slots = _documents(docs, n)
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    table = docs.sparkSession.sparkContext.broadcast(_common(slots, total))
    index = _index(docs, n, percent, table)

    stars = stored(_verified(docs, n, stored(_leaders(index, percent), "leaders")).where(_is_link(percent)), "stars")
    chosen = stars.groupBy(F.col("a").alias("node")).agg(
        F.min(F.struct(_distance().alias("d"), F.col("b").alias("g"))).alias("best"))
    roots = components(stars.select("a", "b"))
    # Every node of a link has a root; only those with a leader of their own have a group.
    groups = stored(
        roots.withColumnRenamed("root", "c").join(chosen, "node", "left")
        .select("node", "c", F.coalesce("best.g", "node").alias("g"), F.coalesce("best.d", F.lit(0.0)).alias("d")),
        "groups")
    labelled = index.join(groups, "node", "left").select(
        "grams", "n", F.coalesce("g", "node").alias("g"), F.coalesce("c", "node").alias("c"))

    radius = groups.groupBy("g").agg(F.max("d").alias("r")).where("r > 0")
    slack = F.lit(1e-9 + 1 - percent / 100)

    def within_reach(frame: DataFrame, distance: str) -> DataFrame:
        """Pairs of leaders near enough for a link between members of their blocks."""
        reach = slack + F.coalesce("ra", F.lit(0.0)) + F.coalesce("rb", F.lit(0.0))
        return (
            frame.join(radius.select(F.col("g").alias("a"), F.col("r").alias("ra")), "a", "left")
            .join(radius.select(F.col("g").alias("b"), F.col("r").alias("rb")), "b", "left")
            .where(F.col(distance) <= reach)
        )

    pairs = stored(_candidates(_entries(labelled), percent), "candidates")
    pairs = stored(within_reach(_plausible(pairs, index, table), "least").select("a", "b"), "plausible")
    crossed = stored(_verified(docs, n, pairs), "crossed")
    links = crossed.where(_is_link(percent)).select("a", "b")

    # What links join by now needs no further answers.
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))

    def with_root(frame: DataFrame, key: str, name: str) -> DataFrame:
        named = frame.join(roots.select(F.col("node").alias(key), F.col("root").alias(name)), key, "left")
        return named.withColumn(name, F.coalesce(name, key))

    near = within_reach(
        crossed.where(~_is_link(percent)).select("a", "b", _distance().alias("d")), "d"
    ).where("ra is not null or rb is not null")
    near = with_root(with_root(near, "a", "ca"), "b", "cb").where("ca != cb")
    # Members of blocks that are near each other but apart are looked up one by one.
    blocks_open = stored(near.select(F.explode(F.array("a", "b")).alias("g")).distinct(), "open")
    if not blocks_open.isEmpty():
        nodes = groups.join(blocks_open, "g").select("node").union(blocks_open).distinct()
        single = with_root(index.join(nodes, "node", "left_semi"), "node", "c").select(
            "grams", "n", F.col("node").alias("g"), "c")
        pairs = stored(_candidates(_entries(single), percent), "members")
        pairs = stored(_plausible(pairs, index, table).where(F.col("least") <= slack).select("a", "b"), "plausible-members")
        links = _verified(docs, n, pairs).where(_is_link(percent)).select("a", "b")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))
    return rows.join(roots, "node", "left").select(
        "rid", "doc_id", "n_shingles", "node", F.coalesce("root", "node").alias("root"))


def linked_documents(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that can be reached by links."""
    joined = stored(ngram_join(docs, n, percent), "joined")
    least = joined.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    keyed = joined.withColumn("key", F.when(F.col("root").isNotNull(), again("root")))
    return keyed.join(least.select("component_id", again("root").alias("key")), "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """The rows of `docs` that stay when of linked documents only the one with the least doc_id does.

    Columns stay as they are. Among equal rows one stays; rows without words all stay.
    """
    joined = stored(ngram_join(docs, n, percent), "joined")
    kept = joined.where("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("kept"))
    # Equal rows without words share a rid: all of them stay.
    blank = joined.where("root is null").select("rid", F.lit(True).alias("blank")).distinct()
    chosen = kept.select(F.col("kept.rid").alias("rid"), F.lit(False).alias("blank")).distinct().union(blank)
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_hash(docs).alias("rid"))
    turn = F.row_number().over(Window.partitionBy("rid").orderBy(F.lit(0)))
    return inner.join(chosen, "rid").withColumn("turn", turn).where("turn = 1 or blank").select("row.*")


#: The same in DuckDB SQL, which forms all pairs that share an n-gram.
SQL = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]))) END AS s
    FROM docs),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (
    SELECT doc_id AS node, doc_id AS other FROM documents
    UNION
    SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, min(other) AS component_id FROM sets JOIN reached ON node = doc_id GROUP BY ALL
"""
