"""Documents of several sources mixed to target weights by weighted fair queueing.

The documents of a source are shuffled by a hash. Each gets a virtual finish time: the tokens of
its source up to and including it, divided by the source's target. Taken in the order of finish
times until the total budget is spent, every source advances at the pace of its target; a source
whose target is above its size starts anew with its first document. Time 1 is where every source
has reached its target.

The global order is found without one task seeing it all. Fair queueing makes finish times near
uniform, so ranges of equal time are even ones: words are summed up per range, only the range in
which the budget ends is divided again, until it is one tick long and the last document that fits
is known. Every row then compares itself with that one, which truncates the global order there.

Cases: a NULL text has no words, and a document without words is never taken. A NULL source is a
source of its own, the last. Equal rows are shuffled side by side. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from weblens.llm.store import row_hash, stored

#: Parts of a shuffled source, added up one by one and then put one after the other.
PARTS = 4096
#: Time is counted in ticks of 2**-36; slices are 2**24, 2**12 and one tick long. What lies
#: behind time `LATE` is one slice; the budget ends there only if documents are about as large
#: as targets.
SHIFTS, LATE = (24, 12, 0), 4
KEY = {"finish": "double", "epoch": "int", "name": "string", "h": "long", "id": "long"}
CYCLE = (1, 2, 3)
MOST = 3


def words(text: Column) -> Column:
    """The number of words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, budget: float, most: float = MOST) -> np.ndarray:
    """Shares of the budget by weight, each at most `most` times the size.

    What a source can not take is shared by weight among the others, until none is above.
    """
    out = np.zeros(len(sizes))
    free = np.ones(len(sizes), bool)
    while free.any():
        share = (budget - out[~free].sum()) * weights / weights[free].sum()
        over = free & (share > most * sizes)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = most * sizes[over]
        free &= ~over
    return out


def _source_key() -> Column:
    return F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"))


def _targets(thin: DataFrame, cycle: tuple[int, ...], most: float) -> DataFrame:
    """(missing, name, source_size, target): a row per source, which is what a mixture lists."""
    sums = thin.groupBy(_source_key().alias("k")).agg(F.sum("size").alias("s")).select("k.missing", "k.name", "s")
    # Strings of Python and of UTF-8 bytes have the same order: that of code points.
    rows = sorted((r.missing, r.name, r.s) for r in sums.collect())
    sizes = np.array([r[2] for r in rows], float)
    weights = np.array([cycle[i % len(cycle)] for i in range(len(rows))], float)
    goal = targets(sizes, weights, sizes.sum(), most)
    return thin.sparkSession.createDataFrame(
        [(*r, float(t)) for r, t in zip(rows, goal)], "missing boolean, name string, source_size long, target double")


def _timed(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """`rows` (row, source, size, h, id) with source_size, target and `upto`, the source's tokens
    up to and including each row in shuffled order."""
    part = F.pmod(F.shiftrightunsigned("h", 40), F.lit(PARTS)).cast("int")
    keyed = rows.withColumns({"part": part, "missing": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    sums = keyed.groupBy("missing", "name", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("missing", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("missing", "name", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("missing", "name", "part").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.withColumn("run", F.sum("size").over(inside)).join(starts, ["missing", "name", "part"])
        .join(goals, ["missing", "name"]).withColumn("upto", F.col("start") + F.col("run"))
    )


def _finish(epoch: Column) -> Column:
    """The virtual finish time of a row's copy, counted from epoch 0."""
    return F.try_divide((epoch * F.col("source_size") + F.col("upto")).cast("double"), F.col("target"))


def _last(timed: DataFrame, most: int) -> tuple[float, int, str, int, int] | None:
    """The order key of the last copy that fits the budget, the sum of all sizes; None for none."""
    order = ["finish", "epoch", "name", "h", "id"]
    key = F.struct(*order)
    copies = stored(
        timed.where("size > 0").select("size", "name", "h", "id", "source_size", "target", "upto")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn("finish", _finish(F.col("epoch")))
        .select("size", *order, F.floor(F.col("finish") * (1 << SHIFTS[0] + 12)).cast("long").alias("tick")), "copies")
    budget = timed.agg(F.sum("size")).first()[0] or 0
    spent, here, late = 0, copies, LATE << 12
    for shift in SHIFTS:
        slot = F.least(F.shiftright("tick", shift), F.lit(late)) if shift == SHIFTS[0] else F.shiftright("tick", shift)
        for at, n in sorted(here.groupBy(slot.alias("slot")).agg(F.sum("size")).collect()):
            if spent + n > budget:
                break
            spent += n
        else:  # all copies fit
            return tuple(copies.agg(F.max(key)).first()[0] or ()) or None
        here = here.where(slot == at)
        if shift == SHIFTS[0] and at == late:
            break
    # What is left of the order is the one slice in which the budget ends.
    run = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    fit = here.withColumn("run", run).where(F.col("run") <= budget - spent).agg(F.max(key)).first()[0]
    first = here.agg(F.min(key)).first()[0]
    if fit is None:
        literal = F.struct(*(F.lit(v).cast(t).alias(c) for v, (c, t) in zip(first, KEY.items())))
        fit = copies.where(key < literal).agg(F.max(key)).first()[0]
    return None if fit is None else tuple(fit)


def mix(rows: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """Rows (row, source, size) with source_size, target and `copies`, how often each is taken.

    `row` is any column, carried along; it also tells rows of a source apart.
    """
    keyed = rows.withColumn("source", F.col("source").cast("string")).withColumn(
        "id", row_hash(rows)).withColumn("h", F.xxhash64(F.lit("shuffle"), F.col("id")))
    thin = stored(keyed.select("source", "size", "h", "id"), "mix")
    goals = _targets(thin, cycle, most)
    last = _last(_timed(thin, goals), most)
    timed = _timed(keyed, F.broadcast(goals))
    if last is None:
        return timed.select("row", "source", "size", "source_size", "target", F.lit(0).alias("copies"))
    limit = F.struct(*(F.lit(v).cast(t).alias(c) for v, (c, t) in zip(last, KEY.items())))

    def taken(e: int) -> Column:
        mine = F.struct(_finish(F.lit(e)).alias("finish"), F.lit(e).alias("epoch"), "name", "h", "id")
        return (mine <= limit).cast("int")

    copies = F.when(F.col("size") > 0, sum((taken(e) for e in range(1, most)), taken(0))).otherwise(0)
    return timed.select("row", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes of each row."""
    rows = docs.select("doc_id", words(F.col("text")).alias("size"), "source", F.xxhash64("text").alias("t"))
    mixed = mix(rows.select(F.struct("doc_id", "t").alias("row"), "source", "size"))
    return mixed.select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, columns unchanged."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source", words(F.col("text")).alias("size"))
    # A row is repeated after the mix, as many times as its copies.
    return mix(rows).where("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
