"""Passages of benchmark items in documents, also edited or paraphrased ones.

Words are runs of letters and digits, ASCII letters lower-cased. Passages are scored by Smith-Waterman
alignment of the words; a score is the share of the points that the item aligned with itself has.

Seeds are pairs of words that stand next to each other or with one word between, in the item and in
the text. The least score itself says how many an aligned passage must have in common with its
item: two matches that are further apart cost two points at least, which is what a match gives. With the
least score s, an item of n words shares s*n - 1 of its pairs within a stretch of (3 - 2s)*n words. Of
these, the pairs most common among the items may be missed up to half; they are left out, and the rarer
half has to be there. So no pair that scores enough is lost, however often its words occur, whoever
shares them and however it is edited: the seeds only say where to align.

A bit table finds the seeds in one pass over different texts, exact joins tell the items, and the hits
of a text and an item are slid over for stretches that have enough. Only those stretches are
read again, cut out and aligned.

Cases: NULL or empty texts have no passage; an item without words is never found. An item of one or
two words is found where it stands as a whole, two also with a word between. Items with equal words
are one. Equal texts are searched once, each row is reported. A NULL id is reported as NULL. Texts are read whole, however
long. No benchmark or no documents: no rows. Only ids and texts are read, further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weblens.llm.store import again, bit_table, stored
from weblens.llm.text import Block, blocks, mix, signed, span_hashes

#: Bits of a table of seeds or of texts: sixteen for each, within these powers of two (0.5 to 32 MB).
LEAST_BITS, MOST_BITS = 22, 28
MATCH, MISMATCH, GAP = 2, -1, -1
#: The least score, as a share of that of the item aligned with itself.
LEAST_SCORE = 0.5

_LETTERS = np.zeros(256, bool)
_LETTERS[48:58] = _LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TEXT = ("h1", "h2")


def _hashed(column: pa.Array) -> Iterator[tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks with starts, ends and hashes of their words, and each text's first word."""
    for block in blocks(column):
        starts, ends, at = block.words(_LETTERS)
        yield block, starts, ends, span_hashes(_LOWER[block.data], starts, ends), at


def _pairs(words: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of each word with the one `apart` places on."""
    return mix(mix(words[:len(words) - apart]) + words[apart:])


def _bits(count: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * count + 1))))


def _marked(table: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a table has the bit of."""
    bits = np.frombuffer(table, np.uint8)
    place = hashes >> np.uint64(61 - int(math.log2(len(bits))))
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _table(frame: DataFrame, column: str, bits: int) -> bytes:
    return bit_table(frame, F.shiftrightunsigned(column, 64 - bits), bits)


def _seeds(benchmark: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Different items (item, item_id, words as 64-bit hashes, n) and their seeds (item, seed, weight,
    need, reach): `weight` places of the item make the seed, and seeds of the weight `need` must lie within `reach` words."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, grams = [], []
            for _, _, _, hashes, at in _hashed(batch.column("text")):
                for low, high in zip(at[:-1], at[1:]):
                    own = hashes[low:high]
                    words.append(own.tobytes())
                    made = [(own, own, own)] if len(own) == 1 else [(own[:-k], own[k:], _pairs(own, k)) for k in (1, 2)[:max(1, len(own) - 1)]]
                    first, second, seed = (signed(np.concatenate(x)).tolist() for x in zip(*made)) if len(own) else ([], [], [])
                    grams.append([{"first": a, "second": b, "seed": s} for a, b, s in zip(first, second, seed)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(words, pa.binary()),
                 pa.array(grams, pa.list_(pa.struct([("first", pa.int64()), ("second", pa.int64()), ("seed", pa.int64())])))],
                ["item_id", "words", "seeds"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = stored(
        benchmark.select("item_id", F.col("text").cast("string"))
        .mapInArrow(task, f"item_id {kind}, words binary, seeds array<struct<first:long,second:long,seed:long>>").where("octet_length(words) > 0")
        .groupBy("words").agg(F.min("item_id").alias("item_id"), F.first("seeds").alias("seeds"))
        .withColumn("item", F.xxhash64("words")).withColumn("n", (F.octet_length("words") / 8).cast("int")), "items")
    each = items.select("item", "n", F.inline("seeds"))
    weighed = each.groupBy("item", "n", "first", "second", "seed").agg(F.count("*").alias("weight"))
    # How common a pair's words are among the items orders the pairs; any order loses nothing.
    spread = each.select("item", F.explode(F.array("first", "second")).alias("word")).distinct().groupBy("word").agg(F.count("*").alias("items"))
    common = (
        weighed.join(spread.select(F.col("word").alias("first"), F.col("items").alias("a")), "first")
        .join(spread.select(F.col("word").alias("second"), F.col("items").alias("b")), "second")
    )
    must = F.greatest(F.ceil(F.lit(least) * F.col("n") - 1), F.lit(1))
    order = Window.partitionBy("item").orderBy(F.desc(F.col("a") * F.col("b")), "seed", "first", "second")
    spent = F.sum("weight").over(order)
    left = common.withColumn("must", must).withColumn("spent", spent).withColumn("out", F.col("spent") <= F.floor(F.col("must") / 2))
    missed = F.coalesce(F.max(F.when(F.col("out"), F.col("spent"))).over(Window.partitionBy("item")), F.lit(0))
    rare = left.withColumn("need", F.col("must") - missed).where("not out").groupBy("item", "n", "need", "seed").agg(F.sum("weight").alias("weight"))
    reach = F.ceil(F.col("n") * (3 - 2 * least)).cast("int")
    return items.select("item", "item_id", "words", "n"), stored(
        rare.select("item", "seed", F.col("weight").cast("int"), F.col("need").cast("int"), reach.alias("reach")), "seeds")


def _text_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(*_text_hashes(text), text.alias("text"))


def _hits(docs: DataFrame, table: bytes, single: bool) -> DataFrame:
    """(h1, h2, places, seeds): the possible seeds of each different text and the words they begin at."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, places, seeds = [], [], []
            for block, _, _, hashes, at in _hashed(batch.column("text")):
                runs = []
                for apart in (0, 1, 2) if single else (1, 2):
                    made = hashes if not apart else _pairs(hashes, apart) if len(hashes) > apart else hashes[:0]
                    hit = np.flatnonzero(_marked(table, made))
                    hit = hit[hit + apart < at[np.searchsorted(at, hit, "right")]]
                    runs.append((hit, made[hit]))
                hit, marks = (np.concatenate(x) for x in zip(*runs))
                order = np.argsort(hit, kind="stable")
                hit, marks = hit[order], marks[order]
                cuts = np.searchsorted(hit, at)
                for t in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[t], cuts[t + 1])
                    row.append(block.first + t)
                    places.append((hit[part] - at[t]).astype(np.int32))
                    seeds.append(signed(marks[part]))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1").take(take), batch.column("h2").take(take), pa.array(places, pa.list_(pa.int32())), pa.array(seeds, pa.list_(pa.int64()))],
                ["h1", "h2", "places", "seeds"])

    found = _texts(docs).mapInArrow(task, "h1 long, h2 long, places array<int>, seeds array<long>")
    return found.groupBy(*_TEXT).agg(F.first("places").alias("places"), F.first("seeds").alias("seeds"))


def stretches(places: np.ndarray, seeds: np.ndarray, weights: np.ndarray, need: int, reach: int) -> list[tuple[int, int]]:
    """Where an alignment may lie: parts around `reach` words that have different seeds of the weight `need`.

    Places are ascending; parts that overlap are joined.
    """
    own = np.unique(seeds, return_index=True)[1]
    if weights[own].sum() < need:
        return []
    held: dict[int, int] = {}
    out: list[tuple[int, int]] = []
    total, low = 0, 0
    at, seed, weight = places.tolist(), seeds.tolist(), weights.tolist()
    for high in range(len(at)):
        n = held.get(seed[high], 0)
        total += 0 if n else weight[high]
        held[seed[high]] = n + 1
        while at[high] - at[low] >= reach:
            held[seed[low]] -= 1
            total -= 0 if held[seed[low]] else weight[low]
            low += 1
        if total >= need:
            part = max(0, at[low] - reach), at[high] + reach + 1
            if out and part[0] <= out[-1][1]:
                out[-1] = out[-1][0], part[1]
            else:
                out.append(part)
    return out


def _candidates(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """(h1, h2, item, parts): the stretches of a text to align with an item."""
    each = hits.select(*_TEXT, F.explode(F.arrays_zip("places", "seeds")).alias("hit")).select(
        *_TEXT, F.col("hit.places").alias("place"), F.col("hit.seeds").alias("seed"))
    known = each.withColumn("key", again("seed")).join(seeds.withColumn("key", again("seed")), ["key", "seed"])
    grouped = known.groupBy(*_TEXT, "item", "need", "reach").agg(F.collect_list(F.struct("place", "seed", "weight")).alias("hits"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = batch.column("hits")
            ends = hit.offsets.to_numpy() - hit.offsets[0].as_py()
            places, seed, weight = (x.to_numpy() for x in hit.flatten().flatten())
            need, reach = (batch.column(c).to_numpy() for c in ("need", "reach"))
            row, parts = [], []
            for i, (low, high) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                order = low + np.argsort(places[low:high], kind="stable")
                found = stretches(places[order], seed[order], weight[order], need[i], reach[i])
                if found:
                    row.append(i)
                    parts.append([{"low": a, "high": b} for a, b in found])
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in ("h1", "h2", "item")),
                 pa.array(parts, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))], ["h1", "h2", "item", "parts"])

    return grouped.mapInArrow(task, "h1 long, h2 long, item long, parts array<struct<low:long,high:long>>")


def _cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, h2, item, first, words, text) of all stretches of the wanted texts."""
    ids = wanted.select(*_TEXT).distinct()
    table = _table(ids, "h1", _bits(ids.count()))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(table, batch.column("h1").to_numpy().view(np.uint64))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, item, first, words, texts = [], [], [], [], []
            for block, starts, ends, hashes, at in _hashed(batch.column("text")):
                for t in range(block.stop - block.first):
                    begin, stop = int(at[t]), int(at[t + 1])
                    for one in batch.column("items")[block.first + t].as_py():
                        for part in one["parts"]:
                            low, high = begin + part["low"], min(stop, begin + part["high"])
                            row.append(block.first + t)
                            item.append(one["item"])
                            first.append(low - begin)
                            words.append(hashes[low:high].tobytes())
                            texts.append(block.data[starts[low]:ends[high - 1]].tobytes())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1").take(take), batch.column("h2").take(take), pa.array(item, pa.int64()), pa.array(first, pa.int64()),
                 pa.array(words, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())],
                ["h1", "h2", "item", "first", "words", "text"])

    schema = "h1 long, h2 long, text string"
    texts = _texts(docs).mapInArrow(chosen, schema).groupBy(*_TEXT).agg(F.first("text").alias("text"))
    per_text = wanted.groupBy(*_TEXT).agg(F.collect_list(F.struct("item", "parts")).alias("items"))
    return texts.join(per_text, list(_TEXT)).select(*_TEXT, "text", "items").mapInArrow(
        cut, "h1 long, h2 long, item long, first long, words binary, text string")


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and the number of the text's words up to its end."""
    steps = np.arange(len(text))
    above = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.maximum(above[:-1] + np.where(text == word, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum(row, 0)
        # A gap in the item costs the same per word, so the best start of one is a running maximum.
        row = np.maximum.accumulate(row - GAP * steps) + GAP * steps
        above[1:] = row
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k + 1
    return best, end


def most_points(item: np.ndarray, text: np.ndarray) -> int:
    """No alignment scores more: a stretch of the item with every word matched that the text has."""
    upto = np.cumsum(np.concatenate(([0], np.where(np.isin(item, text), MATCH, max(MISMATCH, GAP)))))
    return int((upto - np.minimum.accumulate(upto)).max())


def _found(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    """(h1, h2, item_id, score, first_word, words, text) per different text and item found in it."""
    if not 0 < least <= 1:
        raise ValueError("the least score must be above 0 and at most 1")
    items, seeds = _seeds(benchmark, least)
    single = not items.where("n = 1").isEmpty()
    table = _table(seeds, "seed", _bits(seeds.count()))
    hits = _hits(docs, table, single)
    wanted = stored(_candidates(hits, seeds), "candidates")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, len(batch)), np.int64)
            for i, (x, y) in enumerate(zip(batch.column("item_words"), batch.column("words"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if most_points(x, y) < least * MATCH * len(x):
                    continue
                best, end = align(x, y)
                out[0, i] = best
                if best >= least * MATCH * len(x):
                    _, back = align(x[::-1], y[:end][::-1])
                    out[1:, i] = end - back, back
            names = ["h1", "h2", "item_id", "n", "first", "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in names), *map(pa.array, out)], [*names, "points", "start", "length"])

    kind = items.schema["item_id"].dataType.simpleString()
    aligned = (
        _cut_out(docs, wanted).withColumn("key", again("item"))
        .join(items.withColumnRenamed("words", "item_words").withColumn("key", again("item")), ["key", "item"])
        .select("h1", "h2", "item_id", "n", "first", "text", "words", "item_words")
        .mapInArrow(score, f"h1 long, h2 long, item_id {kind}, n int, first long, text string, "
                           "points long, start long, length long")
        .withColumn("score", F.col("points") / (MATCH * F.col("n"))).where(F.col("score") >= least)
    )
    best = F.max(F.struct("score", (-F.col("first") - F.col("start")).alias("back"), "length", "text"))
    return aligned.groupBy(*_TEXT, "item_id").agg(best.alias("b")).select(
        *_TEXT, "item_id", "b.score", (-F.col("b.back")).cast("int").alias("first_word"), F.col("b.length").alias("words"), F.col("b.text").alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, item_id, score, first_word, words, text) per document and item found in it.

    `score` is that of the alignment as a share of the item's own, from `least` to 1; the words
    from `first_word` on, `words` of them, are the aligned passage, `text` is the stretch it lies in.
    """
    found = stored(_found(docs, benchmark, least), "leaks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_hashes(F.col("text").cast("string")))
    # Only texts with a leak go into the join, so it moves no others.
    return rows.join(found, list(_TEXT)).select("doc_id", "item_id", "score", "first_word", "words", "text")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, words and text of every passage found."""
    return contaminated(docs, benchmark)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no item was found, columns unchanged."""
    found = stored(_found(docs, benchmark, LEAST_SCORE).select(*_TEXT).distinct(), "contaminated")
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_text_hashes(F.col("text").cast("string")))
    return inner.join(found, list(_TEXT), "left_anti").select("row.*")
