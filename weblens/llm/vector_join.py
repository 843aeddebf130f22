"""Vectors with a cosine of at least `least`, by a pigeonhole join over subspaces.

Unit vectors are turned by a fixed random rotation and split into blocks of coordinates. Cosines of
at least c are squared distances of at most D = 2 - 2c, and a squared distance is the sum over the
blocks; so in one block at least, a linked pair is within that block's share of D, which is
proportional to its number of coordinates. Each block is joined by range on its own:

* Its vectors are laid out by grid cell (first coordinates of the block, as wide as the range) and
  by the signs of all others, so that copies of a vector lie side by side, and cut into tiles of a
  bounded size. A cell with a third of all vectors is many tiles.
* Tiles of equal or neighbouring cells meet by an equi-join of their summaries: centre and radius
  in each block and in all. Two tiles too far apart in the block, or in all, are dropped. Two
  tiles so tight that all their vectors are linked are settled by their sizes, without a look at a vector.
* For the rest, a run of HOSTS neighbouring tiles is held while their partners stream by, GUESTS of
  them in a turn; turns are dealt out to all tasks. Candidates within the block's budget are verified with the whole vectors, in double precision.
  A pair counts in the first block whose budget it meets and in no other, so the union of all
  blocks' candidates needs no table of pairs: tasks hand on a sum per vector, and one
  link per vector and turn that keeps its component together, never a row per pair.

Equal vectors are one point with a count from the start. Every vector is in the index and the join
is exact: no sample, no cap on partners.

On vectors without structure in many dimensions, grid and radii spare little: then most pairs of tiles are compared,
as products of small matrices. That is the price of exactness, not of the layout.

Cases: vectors that are NULL, empty, zero, or hold a NULL or non-finite component link with nothing
and are kept; so do vectors of another length with each other. -0.0 is 0.0. Repeated rows are
vectors of their own, linked with each other. A NULL id is no smallest id: a component's id is the
smallest known one, NULL where there is none. Ties need no rule, as no result depends on an order.
An empty table gives no rows. Only id and vector are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from weblens.llm.graph import components
from weblens.llm.store import stored

BLOCKS = 4
#: Bytes of a tile's vectors.
TILE = 1 << 20
#: Neighbouring tiles that a task holds at once, and tiles that stream by them in one turn.
HOSTS, GUESTS = 16, 64
#: Coordinates of a block that make up a grid cell, at most; further ones would spare little.
CELL = 6
#: What 32-bit rotated coordinates may be off in a squared distance, with room to spare.
SLACK = 1e-5
#: Candidates verified at a time.
VERIFY = 200_000


@lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    """A random rotation of vectors of a length, the same in every task."""
    rng = np.random.Generator(np.random.PCG64(size + 20240229))
    q, r = np.linalg.qr(rng.standard_normal((size, size)))
    return q * np.sign(np.diag(r))


class Space:
    """Vectors of one length: blocks of coordinates, their budgets, the grid."""

    def __init__(self, size: int, least: float, points: int, width: int, tile: int):
        self.size = size
        self.blocks = min(BLOCKS, size)
        edges = np.linspace(0, size, self.blocks + 1).round().astype(int)
        self.parts = [slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        self.limit = max(2 - 2 * least, 0.0) + SLACK
        self.budgets = [self.limit * (p.stop - p.start) / size for p in self.parts]
        self.tile = max(16, tile // (size * (width + 4) + 16))
        tiles = max(1.0, points / self.tile)
        self.axes = [min(CELL, p.stop - p.start, round(np.log(tiles) / np.log(4))) for p in self.parts]

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        """Rotated unit vectors in 32 bits. They are made once per point and then travel with it, so
        that all tasks see the same distances in a block."""
        scaled = vectors.astype(np.float64)
        scaled /= np.abs(scaled).max(axis=1, keepdims=True)
        scaled /= np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]
        return (scaled @ rotation(self.size)).astype(np.float32)

    def cells(self, turned: np.ndarray, block: int) -> np.ndarray:
        axes, part = self.axes[block], self.parts[block]
        first = turned[:, part.start:part.start + axes].astype(np.float64)
        return np.floor(first / np.sqrt(self.budgets[block])).astype(np.int64)

    def order(self, turned: np.ndarray) -> np.ndarray:
        """The signs of the first coordinates as a number: equal for most copies of a vector."""
        signs = turned[:, :62] > 0
        return signs @ (np.int64(1) << np.arange(signs.shape[1], dtype=np.int64))

    def distances(self, x: np.ndarray, y: np.ndarray, block: int) -> np.ndarray:
        """Squared distances in a block of rows of x and y, the same whichever rows stand around them."""
        d = x[:, self.parts[block]].astype(np.float64) - y[:, self.parts[block]]
        return np.einsum("ij,ij->i", d, d)


@lru_cache(maxsize=64)
def _space(size: int, least: float, points: int, width: int, tile: int) -> Space:
    return Space(size, least, points, width, tile)


@dataclass(frozen=True)
class Setting:
    """What all tasks of a join must agree on: the least cosine, how many points there are of each
    length, the kind of number, the bytes of a tile."""

    least: float
    sizes: dict[int, int]
    kind: np.dtype
    tile: int

    def space(self, size: int) -> Space:
        return _space(size, self.least, self.sizes[size], self.kind.itemsize, self.tile)


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(values.ravel()))


def _binary(values: np.ndarray) -> pa.Array:
    """One binary value per row."""
    flat = np.ascontiguousarray(values)
    ends = np.arange(len(flat) + 1, dtype=np.int64) * flat[0:1].nbytes
    return pa.Array.from_buffers(pa.large_binary(), len(flat), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).cast(pa.binary())


def _rows(column: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind).reshape(len(column), width)


def _points(rows: DataFrame) -> DataFrame:
    """One point per different vector: how many rows have it, and their smallest id."""
    return stored(
        rows.where("vector IS NOT NULL").groupBy("vector")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
        .withColumn("point", F.monotonically_increasing_id()), "points")


def _placed(points: DataFrame, join: Setting) -> DataFrame:
    """Each point once per block, with the cell it falls in, its order and its vectors."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("size").to_numpy()
            for size in np.unique(length).tolist():
                some = batch.filter(pa.array(length == size))
                space = join.space(size)
                given = some.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(join.kind)
                turned = space.turned(given)
                fixed = [pa.array(space.order(turned)), some.column("point"), some.column("copies"), _binary(given), _binary(turned)]
                for block in range(space.blocks):
                    yield pa.RecordBatch.from_arrays(
                        [some.column("size"), pa.array(np.full(some.num_rows, block, np.int32)), _lists(space.cells(turned, block)), *fixed],
                        names=["size", "block", "cell", "place", "point", "copies", "given", "turned"])

    return points.select("point", "copies", "vector", F.size("vector").alias("size")).mapInArrow(
        task, "size int, block int, cell array<long>, place long, point long, copies long, given binary, turned binary")


def _tiles(placed: DataFrame, join: Setting) -> DataFrame:
    """Runs of neighbours in a cell, packed, with centre and radii (one per block, then of all)."""
    schema = ("size int, block int, cell array<long>, first long, weight long, n int, centre binary, "
              "points binary, copies binary, given binary, turned binary")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            size, block, cell = key
            space = join.space(size)
            turned = _rows(rows.column("turned"), np.dtype("<f4"), size).astype(np.float64)
            centre = turned.mean(axis=0)
            off = (turned - centre) ** 2
            radii = [np.sqrt(off[:, p].sum(axis=1).max()) for p in space.parts] + [np.sqrt(off.sum(axis=1).max())]
            points, copies = rows.column("point").to_numpy(), rows.column("copies").to_numpy()
            one = [b"".join(x.as_buffer() for x in rows.column(c)) for c in ("given", "turned")]
            return pa.RecordBatch.from_arrays([
                pa.array([size], pa.int32()), pa.array([block], pa.int32()), pa.array([list(cell)], pa.list_(pa.int64())),
                pa.array([points[0]], pa.int64()), pa.array([int(copies.sum())], pa.int64()), pa.array([len(points)], pa.int32()),
                *(pa.array([x], pa.binary()) for x in (np.append(centre, radii).tobytes(), points.tobytes(), copies.tobytes(), *one))],
                names=["size", "block", "cell", "first", "weight", "n", "centre", "points", "copies", "given", "turned"])

        for batch in batches:
            size, block = batch.column("size").to_numpy(), batch.column("block").to_numpy()
            cell = batch.column("cell").to_pylist()
            keys = list(zip(size.tolist(), block.tolist(), map(tuple, cell)))
            low = 0
            while low < batch.num_rows:
                if held and (keys[low] != key or sum(map(len, held)) >= join.space(key[0]).tile):
                    yield packed()
                    held = []
                key = keys[low]
                room = join.space(key[0]).tile - sum(map(len, held))
                high = low + 1
                while high < batch.num_rows and high - low < room and keys[high] == key:
                    high += 1
                held.append(batch.slice(low, high - low))
                low = high
        if held:
            yield packed()

    ordered = placed.repartitionByRange("size", "block", "cell", "place", "point").sortWithinPartitions(
        "size", "block", "cell", "place", "point")
    return ordered.mapInArrow(task, schema)


def _half(axes: int) -> list[list[int]]:
    """Steps to a cell itself and to one of each two opposite neighbours."""
    return [list(s) for s in product((-1, 0, 1), repeat=axes) if s >= (0,) * axes]


def _met(tiles: DataFrame, join: Setting) -> DataFrame:
    """(a, b, settled) for each pair of tiles that may hold a link, each tile with itself included."""
    summary = tiles.select("tile", "size", "block", "cell", "centre")
    most = max(max(join.space(s).axes) for s in join.sizes)
    steps = F.lit(None)
    for axes in range(most, -1, -1):
        steps = F.when(F.size("cell") == axes, F.array(*(F.array(*(F.lit(x).cast("long") for x in s)) if s else F.array().cast("array<long>")
                                                         for s in _half(axes)))).otherwise(steps)
    reach = summary.select("*", F.explode(steps).alias("step")).select(
        F.col("tile").alias("a"), "size", "block", F.col("centre").alias("centre_a"),
        F.zip_with("cell", "step", lambda c, s: c + s).alias("cell"),
        F.exists("step", lambda s: s != 0).alias("other"))
    pairs = (
        reach.join(summary.select(F.col("tile").alias("b"), "size", "block", "cell", F.col("centre").alias("centre_b")),
                   ["size", "block", "cell"])
        .where(F.col("other") | (F.col("a") <= F.col("b"))).select("a", "b", "size", "block", "centre_a", "centre_b")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, blocks = batch.column("size").to_numpy(), batch.column("block").to_numpy()
            for size in np.unique(length).tolist():
                space = join.space(size)
                wide = size + space.blocks + 1
                for block in np.unique(blocks[length == size]).tolist():
                    some = batch.filter(pa.array((length == size) & (blocks == block)))
                    x, y = (_rows(some.column(c), np.dtype("<f8"), wide) for c in ("centre_a", "centre_b"))
                    apart = (x[:, :size] - y[:, :size]) ** 2
                    centre = np.stack([*(np.sqrt(apart[:, p].sum(axis=1)) for p in space.parts), np.sqrt(apart.sum(axis=1))], axis=1)
                    own, other = x[:, size:], y[:, size:]
                    far = np.sqrt([*space.budgets, space.limit])
                    near = centre - own - other <= far + SLACK
                    # All pairs are within: also pairs inside either tile, which the tile with itself then settles.
                    tight = (centre + own + other <= far - SLACK * 4) & (2 * own <= far - SLACK * 4) & (2 * other <= far - SLACK * 4)
                    earlier = tight[:, :block].any(axis=1)
                    keep = near[:, block] & near[:, -1] & ~earlier
                    settled = tight[:, 0] & tight[:, -1] & (block == 0)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("a").filter(pa.array(keep)), some.column("b").filter(pa.array(keep)), pa.array(settled[keep])],
                        names=["a", "b", "settled"])

    return pairs.mapInArrow(task, "a long, b long, settled boolean")


class Tile:
    def __init__(self, row: dict, kind: np.dtype):
        size = row["size"]
        self.points, self.copies = (np.frombuffer(row[c], "<i8") for c in ("points", "copies"))
        self.given = np.frombuffer(row["given"], kind).reshape(-1, size).astype(np.float64)
        self.turned = np.frombuffer(row["turned"], "<f4").reshape(-1, size)
        scale = np.abs(self.given).max(axis=1)
        # Lengths near the ends of the range of doubles would overflow when squared.
        self.given = np.where(((scale > 1e100) | (scale < 1e-100))[:, None], self.given / scale[:, None], self.given)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.given, self.given))
        self.sums = np.zeros(len(self.points), np.int64)


def _joined(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels of nodes after joining the pairs x-y: the least place of each component."""
    while True:
        low = np.minimum(labels[x], labels[y])
        before = labels.copy()
        np.minimum.at(labels, labels[x], low)
        np.minimum.at(labels, labels[y], low)
        while not np.array_equal(labels, labels[labels]):
            labels = labels[labels]
        if np.array_equal(before, labels):
            return labels


def compare(a: Tile, b: Tile, block: int, space: Space, least: float) -> np.ndarray:
    """Adds what two tiles' links give to their sums; labels that tell the links' components, a's
    rows first, then b's. `a` may be `b`."""
    n, same = len(a.points), a is b
    labels = np.arange(n if same else n + len(b.points))
    part = space.parts[block]
    left, right = a.turned[:, part], b.turned[:, part]
    # x·y - |x|²/2 - |y|²/2 is minus half the squared distance.
    left = np.concatenate((left, -0.5 * np.einsum("ij,ij->i", left, left)[:, None], np.ones((n, 1), np.float32)), axis=1)
    right = np.concatenate((right, np.ones((len(right), 1), np.float32), -0.5 * np.einsum("ij,ij->i", right, right)[:, None]), axis=1)
    floor = np.float32(-0.5 * (space.budgets[block] + SLACK))
    step = max(1, (4 * VERIFY) // max(1, len(right)))
    for low in range(0, n, step):
        near = left[low:low + step] @ right.T >= floor
        if same:
            near &= np.arange(len(right)) > np.arange(low, low + len(near))[:, None]
        hits = np.flatnonzero(near)
        for at in range(0, len(hits), VERIFY):
            x, y = np.divmod(hits[at:at + VERIFY], len(right))
            x += low
            own = space.distances(a.turned[x], b.turned[y], block) <= space.budgets[block]
            x, y = x[own], y[own]
            for other in range(block):
                new = space.distances(a.turned[x], b.turned[y], other) > space.budgets[other]
                x, y = x[new], y[new]
            cosine = np.einsum("ij,ij->i", a.given[x], b.given[y]) / (a.norms[x] * b.norms[y])
            x, y = x[cosine >= least], y[cosine >= least]
            if len(x):
                np.add.at(a.sums, x, b.copies[y])
                np.add.at(b.sums, y, a.copies[x])
                labels = _joined(labels, x, y if same else y + n)
    return labels


def _compared(tiles: DataFrame, pairs: DataFrame, join: Setting) -> DataFrame:
    """(point, links, root): sums over links of a turn, and a point each is in one component with.

    Hosts are runs of HOSTS neighbouring tiles; a guest comes once to a run, for all its partners in it.
    """
    run = F.expr(f"a DIV {HOSTS}").alias("run")  # tiles are numbered one by one within each partition
    visits = pairs.groupBy(run, "b").agg(F.collect_list("a").alias("partners"))
    visits = stored(visits.withColumn("turn", F.floor(F.row_number().over(Window.partitionBy("run").orderBy("b")) / GUESTS).cast("long")), "visits")
    packed = tiles.select("tile", "size", "block", "points", "copies", "given", "turned")
    guests = visits.join(packed.withColumnRenamed("tile", "b"), "b")
    hosts = (
        visits.select("run", "turn", F.explode("partners").alias("b")).distinct()
        .join(packed.withColumnRenamed("tile", "b"), "b").withColumn("partners", F.lit(None).cast("array<long>"))
    )
    columns = ["run", "turn", "partners", "b", "size", "block", "points", "copies", "given", "turned"]
    stream = (
        hosts.select(*columns).unionByName(guests.select(*columns))
        .repartition(visits.count() // GUESTS + 1, "run", "turn")
        .sortWithinPartitions("run", "turn", F.col("partners").isNotNull(), "b")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_buffer() if c in ("points", "copies", "given", "turned") else batch.column(c)[i].as_py()
                       for c in columns}
                if (row["run"], row["turn"]) != at:
                    at, here = (row["run"], row["turn"]), {}
                if row["partners"] is None:
                    here[row["b"]] = Tile(row, join.kind)
                    continue
                space = join.space(row["size"])
                visitor = Tile(row, join.kind)
                for name in row["partners"]:
                    host = here[name]
                    guest = host if row["b"] == name else visitor
                    labels = compare(host, guest, row["block"], space, join.least)
                    both = host.points if guest is host else np.concatenate((host.points, guest.points))
                    sums = host.sums if guest is host else np.concatenate((host.sums, guest.sums))
                    told = np.flatnonzero((sums > 0) | (labels != np.arange(len(both))))
                    host.sums, guest.sums = np.zeros_like(host.sums), np.zeros_like(guest.sums)
                    if len(told):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(both[told]), pa.array(sums[told]), pa.array(both[labels[told]])], names=["point", "links", "root"])

    return stream.mapInArrow(task, "point long, links long, root long")


def _settled(tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same for tiles whose vectors are all linked: each counts the other tile's vectors."""
    weights = tiles.select("tile", "weight", "first")
    whole = pairs.join(weights.select(F.col("tile").alias("a"), F.col("weight").alias("weight_a"), F.col("first").alias("first_a")), "a").join(
        weights.select(F.col("tile").alias("b"), F.col("weight").alias("weight_b"), F.col("first").alias("first_b")), "b")
    gained = (
        whole.select(F.col("a").alias("tile"), F.col("weight_b").alias("gain"))
        .unionByName(whole.where("a != b").select(F.col("b").alias("tile"), F.col("weight_a").alias("gain")))
        .groupBy("tile").agg(F.sum("gain").alias("gain"))
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                points, copies = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in ("points", "copies"))
                # A tile meets itself too: a vector is not its own partner, its copies are counted elsewhere.
                links = batch.column("gain")[i].as_py() - copies
                yield pa.RecordBatch.from_arrays(
                    [pa.array(points), pa.array(links), pa.array(np.full(len(points), points[0]))], names=["point", "links", "root"])

    inside = tiles.select("tile", "points", "copies").join(gained, "tile").mapInArrow(task, "point long, links long, root long")
    across = whole.where("a != b").select(F.col("first_a").alias("point"), F.lit(0).cast("long").alias("links"), F.col("first_b").alias("root"))
    return inside.unionByName(across)


def near_vectors(frame: DataFrame, least: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row, as described above; `least` is above 0."""
    if not 0 < least <= 1:
        raise ValueError("the least cosine must be above 0 and at most 1")
    spark = frame.sparkSession
    element = frame.schema[vector].dataType.elementType
    number = "float" if isinstance(element, T.FloatType) else "double"
    kind = np.dtype("<f4" if number == "float" else "<f8")
    plain = F.transform(F.col(f"`{vector}`"), lambda x: x.cast(number) + F.lit(0).cast(number))
    infinite = [F.lit(float(s)).cast(number) for s in ("inf", "-inf")]
    fine = F.forall(plain, lambda x: x.isNotNull() & ~F.isnan(x) & ~x.isin(*infinite)) & F.exists(plain, lambda x: x != 0)
    rows = frame.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.when(fine, plain).alias("vector"))
    points = _points(rows)
    sizes = {r.size: r["count"] for r in points.groupBy(F.size("vector").alias("size")).count().collect()}
    if sizes:
        join = Setting(least, sizes, kind, tile)
        tiles = stored(_tiles(_placed(points, join), join)
                       .withColumn("tile", F.monotonically_increasing_id()), "tiles")
        pairs = stored(_met(tiles, join), "tile-pairs")
        found = stored(_compared(tiles, pairs.where("NOT settled"), join)
                       .unionByName(_settled(tiles, pairs.where("settled"))), "links")
    else:
        found = spark.createDataFrame([], "point long, links long, root long")
    roots = components(found.select(F.col("point").alias("a"), F.col("root").alias("b")))
    linked = (
        points.join(found.groupBy("point").agg(F.sum("links").alias("links")), "point", "left")
        .join(roots.select(F.col("node").alias("point"), "root"), "point", "left")
        .withColumn("root", F.coalesce("root", "point"))
    )
    names = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = linked.join(names, "root").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # The key of its own lets adaptive execution split a vector that a third of the rows have.
    again = F.xxhash64(F.lit("again"), "vector")
    return (
        rows.withColumn("key", again)
        .join(told.withColumn("key", again), ["key", "vector"], "left")
        .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


#: The same in DuckDB SQL, which compares all pairs.
SQL = """
WITH RECURSIVE fine AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings
    UNION
    SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a),
named AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN named ON node = e.vec_id LEFT JOIN counted ON a = e.vec_id
"""
