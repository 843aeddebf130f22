"""Logs along time: as-of join, one-to-one pairing, requests in flight, client sessions.

All of these follow one key along its whole history, and one key may hold most of a log. So a
history is cut into stretches of time, and what a stretch must know of all earlier ones is carried
over its border by a scan over one small row per key and stretch. Before any window, rows
are reduced to one per key and moment, which bounds a window's rows by the length of a stretch;
rows in full meet the result again in an equi-join on key and moment, which adaptive execution can split.

NULL keys match nothing. Empty logs give empty results, or unmatched rows where rows are kept.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weblens.functions import offset_seconds
from weblens.operators.correlate import KEYS
from weblens.session import shared_folder

MICROS = 1_000_000
#: Seconds of a stretch of time.
STRETCH = 600


def micros(logs: DataFrame, normalise: bool = False, time: str = "timestamp") -> Column:
    """Microseconds of the wall clock, or of UTC where `normalise` asks for it and a zone is known."""
    at = F.col(time)
    days = F.unix_date(F.to_date(at)).cast("long")
    whole = (days * 86400 + F.hour(at) * 3600 + F.minute(at) * 60) * MICROS
    wall = whole + (F.extract(F.lit("SECOND"), at) * MICROS).cast("long")
    if normalise and "tz_offset" in logs.columns:
        return wall - offset_seconds(F.col("tz_offset")) * MICROS
    return wall


def from_micros(value: Column) -> Column:
    return F.timestamp_add("MICROSECOND", value, F.lit("1970-01-01").cast("timestamp_ntz"))


def _stretch(at: Column, length: int) -> Column:
    return F.floor(at / length).cast("long")


# --- carrying over stretches --------------------------------------------------------------------

def last_before(frame: DataFrame, keys: Sequence[str], order: str, value: str, length: int, into: str) -> DataFrame:
    """`frame` with `into`: the last non-NULL `value` of the key at or before the row's `order`.

    `frame` has one row per key and `order`, a number; stretches are `length` of it.
    """
    cut = frame.withColumn("_stretch", _stretch(F.col(order), length))
    ends = cut.groupBy(*keys, "_stretch").agg(
        F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_stretch", F.last("_end.v", ignorenulls=True).over(earlier).alias("_carried"))
    # The carried value goes in front of its stretch as a row of its own: no wide row is joined.
    rows = cut.withColumn("_carry", F.lit(False)).unionByName(
        carried.where(F.col("_carried").isNotNull())
        .select(*keys, "_stretch", F.col("_carried").alias(value), F.lit(True).alias("_carry")), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "_stretch").orderBy(F.desc("_carry"), order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn(into, F.last(value, ignorenulls=True).over(so_far))
        .where(~F.col("_carry")).drop("_carry", "_stretch")
    )


def running_total(frame: DataFrame, keys: Sequence[str], order: str, value: str, length: int, into: str) -> DataFrame:
    """`frame` with `into`: the sum of `value` over the key's rows up to and with the row's `order`."""
    cut = frame.withColumn("_stretch", _stretch(F.col(order), length))
    sums = cut.groupBy(*keys, "_stretch").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_stretch", F.sum("_sum").over(earlier).alias(value))
    rows = cut.withColumn("_carry", F.lit(False)).unionByName(
        carried.where(F.col(value).isNotNull()).withColumn("_carry", F.lit(True)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "_stretch").orderBy(F.desc("_carry"), order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.sum(value).over(so_far)).where(~F.col("_carry")).drop("_carry", "_stretch")


# --- as-of join -----------------------------------------------------------------------------------

def requests_as_of(
    nginx: DataFrame, nexus: DataFrame, within: int | None = None, normalise: bool = False, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Each proxy request with the latest repository request of its key at or before it.

    `repository_id`, `repository_timestamp` and `age_ms` are added, NULL where there is none, or none
    in the last `within` seconds. Of repository requests at one moment the largest id counts.
    """
    if within is not None and within < 0:
        raise ValueError("within must not be negative")
    keys = list(keys)
    repository = nexus.select(*keys, micros(nexus, normalise).alias("_at"), F.struct(
        F.col("id").alias("id"), F.col("timestamp").alias("timestamp"), micros(nexus, normalise).alias("at")).alias("_hit"))
    proxy = nginx.select("*", micros(nginx, normalise).alias("_at"))
    moments = (
        repository.unionByName(proxy.select(*keys, "_at"), allowMissingColumns=True)
        .groupBy(*keys, "_at").agg(F.max("_hit").alias("_hit"))
    )
    found = last_before(moments, keys, "_at", "_hit", STRETCH * MICROS, "_found").select(*keys, "_at", "_found")
    age = F.col("_at") - F.col("_found.at")
    fits = F.lit(True) if within is None else age <= within * MICROS
    return proxy.join(found, [*keys, "_at"], "left").select(
        *(F.col(c) for c in nginx.columns),
        F.when(fits, F.col("_found.id")).alias("repository_id"),
        F.when(fits, F.col("_found.timestamp")).alias("repository_timestamp"),
        F.when(fits, F.floor(age / 1000)).cast("long").alias("age_ms"),
    )


# --- one-to-one pairing ---------------------------------------------------------------------------

class Queue:
    """Requests of one log that wait for a partner in the other, oldest first.

    Only one side can wait: `side` is 1 for proxy requests, -1 for repository requests. An entry is
    [second, number of its first request within that second, how many].
    """

    def __init__(self, state: Sequence[int] = ()) -> None:
        self.side = int(state[0]) if len(state) else 0
        self.waiting = deque([list(state[i:i + 3]) for i in range(1, len(state), 3)])

    def state(self) -> list[int]:
        return [self.side, *(x for entry in self.waiting for x in entry)] if self.waiting else []

    def forget(self, before: int) -> None:
        while self.waiting and self.waiting[0][0] < before:
            self.waiting.popleft()

    def arrive(self, second: int, proxy: int, repository: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(proxy second, number, repository second, number, how many) of the pairs that form."""
        came = {1: [second, 0, proxy], -1: [second, 0, repository]}
        for side, new in ((1, came[-1]), (-1, came[1])):
            if self.side == side:
                yield from self._meet(side, self.waiting, new)
        if came[1][2]:
            yield from self._meet(1, deque([came[1]]), came[-1])
        for side in (1, -1):
            if came[side][2]:
                self.side = side if not self.waiting else self.side
                self.waiting.append(came[side])

    @staticmethod
    def _meet(side: int, waiting: deque, new: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
        while waiting and new[2]:
            old = waiting[0]
            n = min(old[2], new[2])
            first, second = (old, new) if side == 1 else (new, old)
            yield first[0], first[1], second[0], second[1], n
            for entry in (old, new):
                entry[1] += n
                entry[2] -= n
            if not old[2]:
                waiting.popleft()


_PAIR_SCHEMA = "stretch long, state array<long>, incoming array<long>, p_second long, p_number long, r_second long, r_number long, n long"


def _matched(work: DataFrame, keys: list[str], seconds: int, stretch: int) -> DataFrame:
    """Pairs, and the state each stretch began and ended with; rows with a state give what comes in."""
    key_schema = ", ".join(f"{k} string" for k in keys)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = block = now = None
        queue, incoming = Queue(), []
        out: list[tuple] = []

        def close() -> None:
            nonlocal incoming
            if now is not None:
                queue.forget((now + 1) * stretch - seconds)
                out.append((*history, now, queue.state(), incoming, None, None, None, None, None))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            fields = [*((k, pa.string()) for k in keys), ("stretch", pa.int64()), ("state", pa.list_(pa.int64())),
                      ("incoming", pa.list_(pa.int64())), *((c, pa.int64()) for c in ("p_second", "p_number", "r_second", "r_number", "n"))]
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "block", "stretch", "second", "proxy", "repository", "state")]
            for *who, part, piece, second, proxy, repository, state in zip(*columns):
                if who != history or part != block:
                    close()
                    history, block, now, queue = who, part, None, Queue()
                if state is not None:
                    queue = Queue(state)
                    continue
                if piece != now:
                    if now is not None:
                        close()
                    queue.forget(piece * stretch - seconds)
                    now, incoming = piece, queue.state()
                queue.forget(second - seconds)
                for pair in queue.arrive(second, proxy, repository):
                    out.append((*who, piece, None, None, *pair))
                if len(out) > 50_000:
                    yield batch_of(out)
                    out.clear()
        close()
        if out:
            yield batch_of(out)

    return work.mapInArrow(task, f"{key_schema}, {_PAIR_SCHEMA}")


def _kept(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read back: read by several steps, made once."""
    path = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _in_reach(rows: DataFrame, keys: list[str], seconds: int, stretch: int) -> DataFrame:
    """The requests in whose stretch of time the other log has one of their key, or has one at most `seconds` from it.

    All others can neither be paired nor keep another one from its partner. The stretches are told apart by a
    hash of key and number; where two share one, some rows more are kept.
    """
    def place(second: Column) -> Column:
        return F.xxhash64(*keys, _stretch(second, stretch))

    second = F.col("second")
    # As a stretch is longer than twice `seconds`, what is in reach of a request lies in two of them at most.
    marks = F.array_distinct(F.array(place(second - seconds), place(second + seconds)))
    both = (
        rows.select(F.explode(marks).alias("place"), F.when(F.col("is_proxy"), 1).otherwise(2).alias("side"))
        .groupBy("place").agg(F.bit_or("side").alias("sides")).where("sides = 3").select("place")
    )
    return rows.withColumn("place", place(second)).join(both, "place", "left_semi").drop("place")


def request_pairs(
    nginx: DataFrame, nexus: DataFrame, seconds: int = 5, normalise: bool = False, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """(id, repository_id): proxy and repository requests of a key paired one to one, in time order.

    In order of time, and of ids within a second, the first request that still waits is paired with
    the first of the other log at most `seconds` away; a request that finds none in time stays
    alone. For intervals of one length this gives as many pairs as there can be.

    Both logs are read once, for keys, second and id, and only requests with one of the other log in reach
    go on. These are counted per key and second, and the counts are matched by a queue along each stretch of
    time, all stretches at once, each from an empty queue first. Where the queue at a stretch's end is
    not what the next one began with, that key's neighbouring stretches run again from it, in
    blocks twice as long each time. Most queues do not depend on what was waiting long before, so that few run
    again; a key for which they always do ends as one pass over its seconds, not its rows.
    """
    if seconds < 0:
        raise ValueError("seconds must not be negative")
    keys, stretch = list(keys), max(STRETCH, 2 * seconds + 1)

    def narrow(logs: DataFrame, is_proxy: bool) -> DataFrame:
        # The filter stays above explode(), so each stamp is read only once.
        second = F.explode(F.array(F.floor(micros(logs, normalise) / MICROS).cast("long")))
        return logs.select(*(F.col(k).cast("string").alias(k) for k in keys), second.alias("second"),
                           "id", F.lit(is_proxy).alias("is_proxy")).dropna(subset=[*keys, "second"])

    both = _kept(narrow(nginx, True).unionByName(narrow(nexus, False)), "pairing-requests")
    requests = _kept(_in_reach(both, keys, seconds, stretch), "pairing-in-reach")
    counts = _kept(
        requests.groupBy(*keys, "second")
        .agg(F.count_if("is_proxy").alias("proxy"), F.count_if(~F.col("is_proxy")).alias("repository"))
        .withColumn("stretch", _stretch(F.col("second"), stretch)), "pairing-counts")
    none = F.lit(None).cast("array<long>")
    turn, rounds = 0, []
    work = counts.withColumn("block", F.col("stretch")).withColumn("state", none)
    while True:
        ordered = work.repartition(*keys, "block").sortWithinPartitions(*keys, "block", F.desc(F.col("state").isNotNull()), "second")
        rounds.append(_kept(_matched(ordered, keys, seconds, stretch).withColumn("turn", F.lit(turn)), "pairing"))
        found = rounds[0]
        for later in rounds[1:]:
            found = found.unionByName(later)
        ends = found.where("state IS NOT NULL")
        ends = ends.groupBy(*keys, "stretch").agg(F.max(F.struct("turn", "state", "incoming")).alias("end")).select(
            *keys, "stretch", "end.*")
        before = ends.select(*keys, (F.col("stretch") + 1).alias("stretch"), F.col("state").alias("given")).where(F.size("given") > 0)
        wrong = ends.join(before, [*keys, "stretch"], "left").where(
            F.coalesce("given", F.array().cast("array<long>")) != F.col("incoming")).select(*keys, "stretch")
        if wrong.isEmpty():
            break
        wrong = _kept(wrong, "pairing-open")
        turn += 1
        block = _stretch(F.col("stretch"), 2 ** turn)
        blocks = wrong.select(*keys, block.alias("block")).distinct()
        again = counts.withColumn("block", block).join(blocks, [*keys, "block"], "left_semi").withColumn("state", none)
        given = before.withColumn("block", block).where(F.col("stretch") == F.col("block") * 2 ** turn).join(
            blocks, [*keys, "block"], "left_semi")
        work = again.unionByName(given.select(
            *keys, "stretch", "block", F.col("given").alias("state"), *(F.lit(0).cast("long").alias(c) for c in ("second", "proxy", "repository"))))
    last = ends.select(*keys, "stretch", "turn")
    pairs = found.where("n IS NOT NULL").join(last, [*keys, "stretch", "turn"], "left_semi")
    single = pairs.select(*keys, "p_second", "p_number", "r_second", "r_number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).select(
        *keys, "p_second", (F.col("p_number") + F.col("k")).alias("p_number"), "r_second", (F.col("r_number") + F.col("k")).alias("r_number"))
    place = Window.partitionBy(*keys, "is_proxy", "second").orderBy("id")
    numbered = requests.withColumn("number", (F.row_number().over(place) - 1).cast("long"))
    proxy = numbered.where("is_proxy").select(*keys, F.col("second").alias("p_second"), F.col("number").alias("p_number"), "id")
    repository = numbered.where("NOT is_proxy").select(
        *keys, F.col("second").alias("r_second"), F.col("number").alias("r_number"), F.col("id").alias("repository_id"))
    return (
        single.join(proxy, [*keys, "p_second", "p_number"]).join(repository, [*keys, "r_second", "r_number"])
        .select("id", "repository_id")
    )


# --- requests in flight -----------------------------------------------------------------------------

def in_flight_steps(logs: DataFrame, by: Column, name: str, duration_ms: str = "processing_time_ms") -> DataFrame:
    """(name, second, until, requests): how many requests of a group run in each second from `second`
    to before `until`, for every stretch of seconds in which that number stays the same and is not 0.

    A request runs from its time for its duration and counts in each second it touches. Starts are +1
    and ends -1, added up per group and second before anything is shuffled; the running total
    is carried over stretches of time. Rows without a duration do not count.
    """
    start = micros(logs)
    end = start + F.greatest(F.col(duration_ms), F.lit(0)).cast("long") * 1000
    changes = F.array(
        F.struct(F.floor(start / MICROS).cast("long").alias("second"), F.lit(1).cast("long").alias("change")),
        F.struct((F.floor(end / MICROS) + 1).cast("long").alias("second"), F.lit(-1).cast("long").alias("change")))
    steps = (
        logs.where(F.col(duration_ms).isNotNull()).select(by.alias(name), F.explode(changes).alias("c"))
        .where(F.col(name).isNotNull()).groupBy(name, F.col("c.second").alias("second")).agg(F.sum("c.change").alias("change"))
        .where("change != 0")
    )
    total = running_total(steps, [name], "second", "change", 3600, "requests")
    # The next change ends a step; it is looked up from the other end of time, in the same way.
    back = total.select(name, "second", "requests", (-F.col("second")).alias("_back"))
    known = last_before_itself(back, [name], "_back", "second", 3600, "until")
    return known.where("requests > 0").select(name, "second", "until", "requests")


def last_before_itself(frame: DataFrame, keys: Sequence[str], order: str, value: str, length: int, into: str) -> DataFrame:
    """`frame` with `into`: the `value` of the key's row before this one in `order`, NULL for the first."""
    cut = frame.withColumn("_stretch", _stretch(F.col(order), length))
    ends = cut.groupBy(*keys, "_stretch").agg(F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("_end"))
    carried = ends.select(*keys, "_stretch", F.lag("_end.v").over(
        Window.partitionBy(*keys).orderBy("_stretch")).alias("_carried"))
    rows = cut.withColumn("_carry", F.lit(False)).unionByName(
        carried.where(F.col("_carried").isNotNull())
        .select(*keys, "_stretch", F.col("_carried").alias(value), F.lit(True).alias("_carry")), allowMissingColumns=True)
    line = Window.partitionBy(*keys, "_stretch").orderBy(F.desc("_carry"), order)
    return rows.withColumn(into, F.lag(value).over(line)).where(~F.col("_carry")).drop("_carry", "_stretch")


def requests_in_flight(logs: DataFrame, by: Column, name: str, duration_ms: str = "processing_time_ms") -> DataFrame:
    """(name, second, requests): one row per group and second in which a request runs."""
    steps = in_flight_steps(logs, by, name, duration_ms)
    return steps.select(
        name, F.explode(F.sequence(F.col("second"), F.col("until") - 1)).alias("_second"), "requests",
    ).select(name, from_micros(F.col("_second") * MICROS).alias("second"), "requests")


def peak_in_flight(logs: DataFrame, by: Column, name: str, duration_ms: str = "processing_time_ms") -> DataFrame:
    """(name, peak, first_reached): the most requests of a group at once, and the first second of that."""
    steps = in_flight_steps(logs, by, name, duration_ms)
    best = steps.groupBy(name).agg(F.max(F.struct("requests", (-F.col("second")).alias("back"))).alias("best"))
    return best.select(name, F.col("best.requests").alias("peak"), from_micros(-F.col("best.back") * MICROS).alias("first_reached"))


# --- sessions ---------------------------------------------------------------------------------------

def client_sessions(logs: DataFrame, gap: int = 1800, by: str = "ip_address") -> DataFrame:
    """One row per session: client, number, first and last time, requests, bytes.

    A session ends where the next request of the client is `gap` seconds or more away. Requests are reduced to one
    row per client and moment; the moment before is found across stretches, and numbers are the
    running total of beginnings, so a client with most of the log is many windows.
    """
    if gap <= 0:
        raise ValueError("gap must be positive")
    moments = (
        logs.where(F.col(by).isNotNull() & F.col("timestamp").isNotNull())
        .groupBy(by, micros(logs).alias("at"))
        .agg(F.count("*").alias("n"), F.sum("response_size").alias("size"))
    )
    length = max(gap, STRETCH) * MICROS
    placed = last_before_itself(moments, [by], "at", "at", length, "previous")
    begins = F.coalesce(F.col("at") - F.col("previous") >= gap * MICROS, F.lit(True))
    numbered = running_total(placed.withColumn("begins", begins.cast("long")), [by], "at", "begins", length, "session")
    return numbered.groupBy(by, "session").agg(
        from_micros(F.min("at")).alias("first_request"), from_micros(F.max("at")).alias("last_request"),
        F.sum("n").alias("requests"), F.sum("size").alias("bytes"),
    )
