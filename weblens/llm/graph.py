"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weblens.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b, both long); nodes joined by links share a root.

    In each round every node moves to the neighbour (or itself) with the least hash, and links
    between nodes that have met fall away. Hashes stay the same in all rounds: in a star the
    least leaf is next to all others after the first round, so two rounds end it, where hashes
    of each round would halve it. A chain loses a constant share of its nodes in each. Neighbours
    are reduced to their least before the shuffle, so a node with very many links is never
    gathered anywhere. Every round is written out, which keeps plans short and survives lost
    executors.
    """
    edges = stored(
        links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(), "links")
    moves: DataFrame | None = None

    def ranked(node: str):
        return F.struct(F.xxhash64(F.lit("rank"), F.col(node)).alias("h"), F.col(node).alias("n"))

    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        step = stored(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(F.least(ranked("a"), ranked("b"))).alias("m"))
            .select("node", F.col("m.n").alias("root")), "moves")
        moved = (
            edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra != rb")
        )
        edges = stored(
            moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "links")
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moves = stored(
                moves.join(later, "root", "left")
                .select("node", F.coalesce("next", "root").alias("root")), "roots")
    if moves is None:
        return links.sparkSession.createDataFrame([], "node long, root long")
    return moves
