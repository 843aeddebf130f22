"""Rows dealt out to shards on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many arcs of a ring of 64-bit hashes; a row belongs to the arc its key falls in.
A shard holds its exact share of all rows and no more: what an arc has beyond the room of its
shard goes on clockwise, to the shard of the next arc, until it finds room. Row counts of any
two shards so differ by one at most, even if one key has a third of all rows, and rows only
leave the shard of their own arc where that is full.

Cases: a NULL key is a key of its own. Equal rows are told apart only by number, so which of them
gets which of their places is open, what the table holds is not. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from weblens.llm.store import row_hash

VIRTUAL_NODES = 64
#: Parts of an arc. Rows are numbered within a part by one task; parts of an arc are put one
#: after the other by their counts, of which there are at most arcs times parts.
PARTS = 1024


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the arcs in ascending order, and the shard that owns each arc."""
    def place(shard: int, k: int) -> int:
        digest = hashlib.blake2b(f"{shard}/{k}".encode(), digest_size=8).digest()
        return int.from_bytes(digest, "big", signed=True)

    places = sorted((place(s, k), s) for s in range(shards) for k in range(virtual_nodes))
    return np.array([p for p, _ in places], np.int64), np.array([s for _, s in places], np.int32)


def flow(counts: np.ndarray, owners: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each arc go: (arc, first row, row after the last, shard, first slot).

    Rows of an arc are numbered from 0. In each turn all rows without a place ask the next shard
    clockwise, arcs in ring order, and a shard takes as many as it has room for. Work and result
    depend on the number of arcs, not on the rows.
    """
    total = int(counts.sum())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    size = list(room)
    left = [int(c) for c in counts]
    taken = [0] * len(counts)
    out = []
    for hop in range(len(counts)):
        if not any(left):
            break
        for arc in range(len(counts)):
            shard = int(owners[(arc + hop) % len(counts)])
            n = min(left[arc], room[shard])
            if n:
                out.append((arc, taken[arc], taken[arc] + n, shard, size[shard] - room[shard]))
                left[arc] -= n
                taken[arc] += n
                room[shard] -= n
    return out


def _arc(position: Column, ends: np.ndarray) -> Column:
    """The arc of a position: the first whose end is not before it; past the last, the first.

    The number of ends below the position is found by halving, so that a row compares it with a
    few ends and not with all.
    """
    table = F.array(*(F.lit(int(e)) for e in ends))
    low = F.lit(0)
    step = 1 << (len(ends).bit_length() - 1)
    # A row's steps are folded over a short array: each doubles the precision of the last.
    steps = F.array(*(F.lit(step >> k) for k in range(step.bit_length())))
    found = F.aggregate(steps, low, lambda at, s: F.when(
        (at + s <= len(ends)) & (F.get(table, at + s - 1) < position), at + s).otherwise(at))
    return F.pmod(found, F.lit(len(ends)))


def shard(rows: DataFrame, shards: int = 16, key: str = "doc_id", virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """`rows` with `shard` and `slot`, the row's place in its shard, gapless from 0.

    Counts per part of an arc are taken first, over all rows; which rows overflow is settled on
    the counts of the arcs alone. Columns named shard or slot are replaced.
    """
    spark = rows.sparkSession
    given = [c for c in rows.columns if c not in ("shard", "slot")]
    ends, owners = ring(shards, virtual_nodes)
    spread = row_hash(rows, "part")
    placed = rows.select(
        F.struct(*(F.col(f"`{c}`") for c in given)).alias("row"), spread.alias("spread"),
        F.xxhash64(F.lit("ring"), F.col(f"`{key}`")).alias("position"),
    ).withColumn("arc", _arc(F.col("position"), ends)).withColumn("part", F.pmod("spread", F.lit(PARTS)).cast("int"))

    parts = placed.groupBy("arc", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(len(ends), np.int64)
    for arc, n in parts.groupBy("arc").agg(F.sum("n")).collect():  # a row per arc
        counts[arc] = n
    pieces = spark.createDataFrame(
        flow(counts, owners, shards), "arc int, first long, stop long, shard int, slot0 long")

    before = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("arc", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("arc", "part").orderBy("position", "spread")) - 1
    ranked = placed.withColumn("number", number).join(starts, ["arc", "part"]).withColumn(
        "rank", F.col("start") + F.col("number"))
    # There are a few pieces per arc, whatever the number of rows.
    return ranked.join(F.broadcast(pieces), "arc").where("rank >= first and rank < stop").select(
        "row.*", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))


def sharded_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1
    thin = docs.select(
        "doc_id", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    return shard(thin, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
