"""Answers that grow with the stream: windowed counts, client sessions, requests that never arrived.

Sessions are a stateful operator of Structured Streaming: what is open stays in Spark's state store until the
watermark has passed, then a result is final and leaves in append mode. Missing requests do the same with whole
requests, too much for a state store in memory; what is open waits in files.

Windowed counts are sums, so they need no row-level state: each batch adds its own sums to the
folder, under its number, and the answer is their total. A restart repeats a batch under the same number
and replaces what the first try left. Spark's own windows drop late rows in silence; here every row older than
the watermark is a row of the quarantine, so that counts and quarantine together are all lines.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from weblens.formats import LogFormat
from weblens.operators import parse as p
from weblens.operators.correlate import KEYS, requests_missing_in_repository
from weblens.operators.timeline import MICROS, from_micros, micros
from weblens.session import child_files, child_folders, path_kind, read_small, remove_folder, rename, write_small
from weblens.streaming.incremental import stream_lines

LATE = "Older than the watermark"


def parsed_stream(spark: SparkSession, folder: str, fmt: LogFormat, globs: str | Sequence[str] | None = None,
                  files_per_batch: int = 1000) -> DataFrame:
    """The lines of a folder as a stream of typed rows, rejected ones with their reason."""
    return p.parse(stream_lines(spark, folder, fmt, globs, files_per_batch), fmt)


class WindowCounts:
    """Requests per window of event time, kept below a folder.

    `windows` are (length, step) in seconds; a step as long as the window makes tumbling windows, a
    shorter one, of which the length must be a multiple, sliding ones. The watermark is `delay` seconds before the
    latest time of all earlier batches. A row older than that counts nowhere and goes to the
    quarantine; so a window that ends at or before the watermark is final.
    """

    def __init__(self, spark: SparkSession, root: str, fmt: LogFormat, windows: Sequence[tuple[int, int]],
                 keys: Sequence[str] = (), delay: int = 600) -> None:
        if delay < 0 or not windows or any(step <= 0 or length <= 0 or length % step for length, step in windows):
            raise ValueError("windows are (length, step) with the length a multiple of the step, the delay is not negative")
        self.spark, self.root, self.fmt = spark, root.rstrip("/"), fmt
        self.windows, self.keys, self.delay = list(windows), list(keys), delay

    def _batches(self, kind: str) -> list[int]:
        return sorted(int(n.removeprefix("batch=")) for n in child_folders(self.spark, f"{self.root}/{kind}") if n.startswith("batch="))

    def watermark(self, before: int | None = None) -> int | None:
        """Microseconds of the watermark after all batches, or after those before a number."""
        done = [n for n in self._batches("progress") if before is None or n < before]
        if not done:
            return None
        latest = self.spark.read.parquet(f"{self.root}/progress/batch={done[-1]}").first().latest
        return None if latest is None else latest - self.delay * MICROS

    def add(self, parsed: DataFrame, number: int) -> None:
        """Count a batch of parsed lines. The same number again replaces what it left before."""
        mark = self.watermark(before=number)
        rows = parsed.withColumn("_at", micros(parsed)).persist()
        try:
            good = F.col("reason").isNull()
            late = good & (F.col("_at") < mark) if mark is not None else F.lit(False)
            self._write(self._sums(rows.where(good & ~late)), "counts", number)
            refused = rows.withColumn("reason", F.when(late, LATE).otherwise(F.col("reason")))
            self._write(p.quarantine(refused, self.fmt).drop("ingested_at"), "quarantine", number)
            seen = None if mark is None else mark + self.delay * MICROS
            # Written last: a batch without this row is not done.
            latest = rows.where(good & ~late).agg(F.greatest(F.max("_at"), F.lit(seen).cast("long")).alias("latest"))
            self._write(latest, "progress", number)
        finally:
            rows.unpersist()

    def _write(self, frame: DataFrame, kind: str, number: int) -> None:
        frame.write.mode("overwrite").parquet(f"{self.root}/{kind}/batch={number}")

    def _sums(self, rows: DataFrame) -> DataFrame:
        """Rows are counted per smallest unit of time first; only units are copied to their windows."""
        unit = math.gcd(*(step for _, step in self.windows))
        counted = rows.groupBy(*self.keys, (F.floor(F.col("_at") / (unit * MICROS)) * unit).cast("long").alias("_unit")).agg(
            F.count("*").alias("requests"))
        def starts(length: int, step: int):
            last = (F.floor(F.col("_unit") / step) * step).cast("long")
            return F.transform(F.sequence(last - (length - step), last, F.lit(step).cast("long")), lambda at: F.struct(
                F.lit(length).alias("length"), F.lit(step).alias("step"), at.alias("start")))
        in_windows = F.concat(*(starts(*w) for w in self.windows))
        return (
            counted.select(*self.keys, F.explode(in_windows).alias("w"), "requests")
            .groupBy(*self.keys, "w.length", "w.step", "w.start").agg(F.sum("requests").alias("requests"))
        )

    def _done(self, kind: str, schema: str) -> DataFrame:
        """The rows of all finished batches."""
        done = self._batches("progress")
        if not done:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.root}/{kind}").where(F.col("batch") <= done[-1])

    def counts(self, closed_only: bool = False) -> DataFrame:
        """keys, length, step, window_start, requests and whether the window is closed."""
        keys = "".join(f"`{k}` {self.fmt.schema[k].dataType.simpleString()}, " for k in self.keys)
        mark = self.watermark()
        closed = F.lit(False) if mark is None else (F.col("start") + F.col("length")) * MICROS <= mark
        total = self._done("counts", f"{keys}length int, step int, start long, requests long").groupBy(
            *self.keys, "length", "step", "start").agg(F.sum("requests").alias("requests"))
        shown = total.select(
            *self.keys, "length", "step", from_micros(F.col("start") * MICROS).alias("window_start"), "requests", closed.alias("closed"))
        return shown.where("closed") if closed_only else shown

    def quarantine(self) -> DataFrame:
        """Rejected lines and late rows with their reason."""
        return self._done("quarantine", "format string, file_source string, raw_line string, reason string").drop("batch")


def count_windows(
    counts: WindowCounts, folder: str, checkpoint: str, globs: str | Sequence[str] | None = None, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Count all files not seen before, then stop."""
    stream = parsed_stream(counts.spark, folder, counts.fmt, globs, files_per_batch)
    return (
        stream.writeStream.foreachBatch(counts.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _event_time(rows: DataFrame) -> Column:
    """The wall clock as the kind of time watermarks want, whatever the session's zone."""
    return F.timestamp_micros(micros(rows))


def _second(rows: DataFrame) -> Column:
    return F.floor(micros(rows) / MICROS).cast("long")


def session_stream(rows: DataFrame, gap: int = 1800, delay: int = 600, by: str = "ip_address") -> DataFrame:
    """Sessions of a stream of good rows, each given out once it can no longer grow; as `timeline.client_sessions`."""
    return (
        rows.where(F.col(by).isNotNull()).withColumn("_time", _event_time(rows)).withWatermark("_time", f"{delay} seconds")
        .groupBy(by, F.session_window("_time", f"{gap} seconds").alias("w"))
        .agg(F.max("timestamp").alias("last_request"), F.count("*").alias("requests"), F.sum("response_size").alias("bytes"))
        .select(by, from_micros(F.unix_micros("w.start")).alias("first_request"), "last_request", "requests", "bytes")
    )


class MissingRequests:
    """Proxy requests of a stream that the repository log holds no counterpart of.

    What arrives waits in Parquet files below the checkpoint, in `missing`, not in a state store, which would hold it in
    the executors' memory. A request is final once no counterpart can come any more; all that have become final
    since are then matched in one anti join, which spills, and only what is still open is kept.

    Watermarks are those of Spark's joins of streams. Each log's is `delay` seconds before its latest time, the lesser counts, a log
    of which the run has seen nothing holds it back, and it never goes back. A batch leaves out what is not
    younger than the watermark of the batch before, then gives out what its own makes final; what the last batch
    adds to the watermark counts when the run ends.

    A step is a batch (twice its number) or the end of a run (one more). It is done when its JSON file is there; what
    it gives out is then moved to the answer, or at the next start, so rows are shown once whatever breaks off.
    """

    def __init__(self, nginx: DataFrame, nexus: DataFrame, seconds: int = 5, delay: int = 600, keys: Sequence[str] = KEYS) -> None:
        if seconds < 0 or delay < 0:
            raise ValueError("seconds and the delay must not be negative")
        self.spark, self.schema, self.columns = nginx.sparkSession, nginx.schema, nginx.columns
        self.seconds, self.delay, self.keys = int(seconds), int(delay), list(keys)
        proxy = nginx.withColumn("p_second", _second(nginx))
        repository = nexus.select(*(F.col(k).alias(f"r_{k}") for k in keys), F.col("timestamp").alias("r_timestamp"),
                                  _second(nexus).alias("r_second"))
        self.arriving = proxy.unionByName(repository, allowMissingColumns=True)

    def start(self, folder: str, checkpoint: str) -> StreamingQuery:
        """Write final requests as Parquet files, process what is there, then stop; returns when that is done."""
        self.folder, self.root = folder.rstrip("/"), f"{checkpoint.rstrip('/')}/missing"
        for path in (f"{checkpoint.rstrip('/')}/state", f"{self.folder}/_spark_metadata"):
            if path_kind(self.spark, path):
                raise ValueError(f"{path} is of a join in Spark's state store, which is not continued; use new folders")
        self._place(self._last())
        for name in child_folders(self.spark, self.folder):
            if name.startswith("_step-"):  # of a step that broke off
                remove_folder(self.spark, f"{self.folder}/{name}")
        if not child_files(self.spark, self.folder):  # an answer without rows can be read as well
            self.spark.createDataFrame([], self.schema).write.mode("append").parquet(self.folder)
        seen: dict[str, int] = {}
        query = (
            self.arriving.writeStream.foreachBatch(lambda batch, number: self._add(batch, 2 * number, seen))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        last = self._last()
        if last is not None:
            state = self._state(last)
            if state["mark"] > state["given"]:
                state = self._given(last | 1, state)
                self._end(last | 1, state)
                self._keep_only(state["folders"])
        return query

    def _add(self, batch: DataFrame, step: int, seen: dict[str, int]) -> None:
        """Take in a batch; `seen` has the latest second of each log in this run. A step that is done is not done again."""
        before, done = self._state(self._last(step)), self._last() == step
        state = self._state(step) if done else before
        if not done:
            late, folder = state["given"], f"step={step}/arrived"
            batch.where((F.col("p_second") > late) | (F.col("r_second") > late)).write.mode("overwrite").parquet(f"{self.root}/{folder}")
            latest = self._read([folder]).agg(F.max("p_second").alias("proxy"), F.max("r_second").alias("repository")).first()
            state = state | {"folders": [*state["folders"], folder], "latest": latest.asDict()}
            if state["mark"] > late:
                state = self._given(step, state)
        for name, second in state["latest"].items():
            if second is not None:
                seen[name] = max(second, seen.get(name, second))
        if not done:
            reached = min(seen.get(name, self.delay) for name in ("proxy", "repository")) - self.delay
            self._end(step, state | {"mark": max(state["mark"], reached)})
        # What waited before is needed until Spark has noted that this batch is done.
        self._keep_only([*state["folders"], *before["folders"]])

    def _given(self, step: int, state: dict) -> dict:
        """Give out what the watermark makes final; the state with what is kept."""
        mark, waiting = state["mark"], self._read(state["folders"])
        final = F.col("p_second") + self.seconds < mark
        requests = waiting.where(final).select(*self.columns)
        repository = waiting.where(F.col("r_second").isNotNull()).select(
            *(F.col(f"r_{k}").alias(k) for k in self.keys), F.col("r_timestamp").alias("timestamp"))
        missing = requests_missing_in_repository(requests, repository, self.seconds, keys=self.keys)
        missing.select(*self.columns).write.mode("overwrite").parquet(f"{self.folder}/_step-{step}")
        # A kept request is not older than `mark - seconds`, so its counterparts not than `mark - 2 * seconds`.
        kept = waiting.where(~final | (F.col("r_second") >= mark - 2 * self.seconds))
        kept.write.mode("overwrite").parquet(f"{self.root}/step={step}/kept")
        return state | {"folders": [f"step={step}/kept"], "given": mark}

    def _end(self, step: int, state: dict) -> None:
        write_small(self.spark, f"{self.root}/{step}.json", json.dumps(state))
        self._place(step)

    def _place(self, step: int | None) -> None:
        """Move what a step that is done has given out to the answer."""
        aside = f"{self.folder}/_step-{step}"
        for name in child_files(self.spark, aside):
            if name.startswith("part-"):
                rename(self.spark, f"{aside}/{name}", f"{self.folder}/part-{step:010}-{name.removeprefix('part-')}")
        remove_folder(self.spark, aside)

    def _last(self, before: int | None = None) -> int | None:
        names = (n.removesuffix(".json") for n in child_files(self.spark, self.root) if n.endswith(".json"))
        return max((int(n) for n in names if before is None or int(n) < before), default=None)

    def _state(self, step: int | None) -> dict:
        """Watermark, the watermark up to which all is given out, and the folders of what waits."""
        if step is None:
            return {"mark": 0, "given": 0, "folders": [], "latest": {}}
        return json.loads(read_small(self.spark, f"{self.root}/{step}.json"))

    def _read(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.arriving.schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def _keep_only(self, folders: Sequence[str]) -> None:
        for step in child_folders(self.spark, self.root):
            for kind in child_folders(self.spark, f"{self.root}/{step}"):
                if f"{step}/{kind}" not in folders:
                    remove_folder(self.spark, f"{self.root}/{step}/{kind}")


def missing_stream(
    nginx: DataFrame, nexus: DataFrame, seconds: int = 5, delay: int = 600, keys: Sequence[str] = KEYS,
) -> MissingRequests:
    """Proxy requests of a stream that the repository log holds no counterpart of, for `append_to`."""
    return MissingRequests(nginx, nexus, seconds, delay, keys)


def append_to(stream: DataFrame | MissingRequests, folder: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's final rows as Parquet files, process what is there, then stop."""
    if isinstance(stream, MissingRequests):
        return stream.start(folder, checkpoint)
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", folder)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
