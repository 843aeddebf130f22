"""Ingest into Parquet tables and the tables' queries.

One pass over the logs writes good lines, rejected lines and skipped sources of a format
together, into the folders of one dataset:

    <root>/<table>/origin=<name>/ingest=<n>/outcome=parsed|rejected|skipped/log_date=<day>/

so nothing is read or parsed twice, and every reader prunes to the part it wants. Statistics
are counted afterwards on the few columns they need. Ingests are numbered per origin: plain
ingests share one, every stream has its own, so neither can replace what the other stored.
Every ingest is a write to a folder of its own: writers of different origins do not meet, a retry
replaces that folder and nothing else, and numbers come from folder names without a look at rows.

A fresh start is told by two small files beside the ingests. The first names the new ingest, which
readers leave out while it is written; the second, which is there at one stroke, says up to which
numbers the older ingests are over. So a reader sees the old rows or the new ones, also if the driver
dies anywhere between; what is over is removed afterwards, at the latest by the next fresh start.

Statistics of a store come from summaries: per ingest and day the counts, the bounds of time and a
sketch of the clients, made once for each ingest that has none yet, then merged.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import time
from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from weblens import schemas
from weblens.formats import FORMATS, LogFormat
from weblens.operators import catalog, correlate, parse as p, quality, traffic
from weblens.session import child_files, child_folders, path_kind, read_small, remove_folder, write_small
from weblens.sources.discover import MAX_DEPTH, read_logs

PARTITIONS = ("outcome", "log_date")
PLAIN_ORIGIN = "batch"
#: Bits of a sketch of clients: 2**LG_K registers, an error of about 1.6 %.
LG_K = 12


def utc_now() -> Column:
    """The time of the query as a UTC wall clock."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


@dataclass(frozen=True)
class IngestReport:
    """What an ingest wrote, and how fast."""

    format: str
    ingest: int
    lines: int
    entries: int
    parse_errors: int
    skipped: int
    seconds: float

    @property
    def success_rate(self) -> float:
        return self.entries / self.lines if self.lines else 1.0

    @property
    def lines_per_second(self) -> float:
        return self.lines / self.seconds if self.seconds else 0.0

    @property
    def entries_per_second(self) -> float:
        return self.entries / self.seconds if self.seconds else 0.0


class LogStore:
    """The log tables below one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self._yields: dict[str, list[T.StructField]] = {}

    # --- writing ----------------------------------------------------------------------------

    def path(self, fmt: LogFormat) -> str:
        return f"{self.root}/{fmt.table_name}"

    def _stored_schema(self, fmt: LogFormat) -> T.StructType:
        return T.StructType([
            *(T.StructField(f.name, f.dataType, True) for f in fmt.schema.fields),
            *self._extra_fields(fmt),
            T.StructField("file_path", T.StringType()), T.StructField("reason", T.StringType()),
            T.StructField("outcome", T.StringType()), T.StructField("origin", T.StringType()),
            T.StructField("ingest", T.LongType()), T.StructField("log_date", T.DateType()),
        ])

    def _extra_fields(self, fmt: LogFormat) -> list[T.StructField]:
        """Columns a format yields beyond its table's declared ones."""
        if fmt.name not in self._yields:
            probe = self.spark.createDataFrame([], schemas.RAW_LINES)
            declared = {*fmt.schema.names, "file_path", "reason", "outcome"}
            fields = p.parse(probe, fmt).schema.fields
            self._yields[fmt.name] = [f for f in fields if f.name not in declared]
        return self._yields[fmt.name]

    def _stored(self, fmt: LogFormat) -> DataFrame:
        schema = self._stored_schema(fmt)
        if path_kind(self.spark, self.path(fmt)) is None:
            return self.spark.createDataFrame([], schema)
        over, pending = self._starts(fmt)
        rows = self.spark.read.schema(schema).parquet(self.path(fmt))
        for origin, last in over.items():
            rows = rows.where((F.col("origin") != origin) | (F.col("ingest") > last))
        for origin, number in pending:
            rows = rows.where((F.col("origin") != origin) | (F.col("ingest") != number))
        return rows

    def _starts(self, fmt: LogFormat) -> tuple[dict[str, int], list[tuple[str, int]]]:
        """Up to which number each origin's ingests are over, and ingests that are not to be read yet.

        `begin-<n>` names the ingest of fresh start n, `done-<n>` says what it has ended.
        """
        folder = f"{self.path(fmt)}/_fresh"
        names = [n for n in child_files(self.spark, folder) if re.fullmatch(r"(begin|done)-\d+", n)]
        done = max((int(n.removeprefix("done-")) for n in names if n.startswith("done-")), default=-1)
        over = json.loads(read_small(self.spark, f"{folder}/done-{done}")) if done >= 0 else {}
        begun = [n for n in names if n.startswith("begin-") and f"done-{n.removeprefix('begin-')}" not in names]
        return over, [tuple(json.loads(read_small(self.spark, f"{folder}/{n}"))) for n in begun]

    def _ingests(self, fmt: LogFormat) -> dict[str, list[int]]:
        """Numbers of the ingests of each origin that count, smallest first."""
        over, pending = self._starts(fmt)
        return {origin: [n for n in numbers if n > over.get(origin, -1) and (origin, n) not in pending]
                for origin, numbers in self._folders(fmt).items()}

    def _folders(self, fmt: LogFormat) -> dict[str, list[int]]:
        """Numbers of all ingests of each origin, smallest first, from folder names alone."""
        found = {}
        for origin in child_folders(self.spark, self.path(fmt)):
            if origin.startswith("origin="):
                names = child_folders(self.spark, f"{self.path(fmt)}/{origin}")
                numbers = (int(n.removeprefix("ingest=")) for n in names if n.startswith("ingest="))
                found[origin.removeprefix("origin=")] = sorted(numbers)
        return found

    def _folder(self, fmt: LogFormat, origin: str, ingest: int) -> str:
        return f"{self.path(fmt)}/origin={origin}/ingest={ingest}"

    def _largest_id(self, fmt: LogFormat, ingests: dict[str, list[int]]) -> int:
        """The largest id of some ingests, -1 for none.

        Ids only grow, so it is in the newest ingest of some origin that has rows.
        """
        largest = -1
        for origin, numbers in ingests.items():
            for number in reversed(numbers):
                ids = self.spark.read.schema("id long").parquet(self._folder(fmt, origin, number))
                found = ids.agg(F.max("id")).first()[0]
                if found is not None:
                    largest = max(largest, found)
                    break
        return largest

    def write(
        self, lines: DataFrame, fmt: LogFormat, fresh: bool = False, rebalance: bool = False,
        origin: str = PLAIN_ORIGIN, ingest: int | None = None,
    ) -> IngestReport:
        """Parse lines (`schemas.RAW_LINES`) and store them.

        `fresh` replaces the table at one stroke once all is written, else the lines are added. With an explicit
        `ingest` number the write replaces just what an earlier try of that number of the same
        origin left, so a retried batch is stored once. Writers of different origins may run at
        the same time, their ids may then overlap; plain ingests run one after the other, and
        nobody else writes during a fresh start. `rebalance` evens out file sizes per day at the price
        of a shuffle; a day holding most of the rows is split over several files.
        """
        return self._save(p.parse(lines, fmt), fmt, fresh, rebalance, origin, ingest)

    def insert(self, rows: DataFrame, fmt: LogFormat | str, fresh: bool = False) -> int:
        """Store rows that are parsed already; their number.

        A required text column the rows lack is stored as the empty text, a required number as
        0. A required value that is NULL fails the job, and then none of the rows is stored.
        """
        fmt = FORMATS[fmt] if isinstance(fmt, str) else fmt

        def stored(field: T.StructField) -> Column:
            if field.name in rows.columns:
                value = F.col(field.name).cast(field.dataType)
                if field.nullable:
                    return value
                return F.coalesce(value, F.raise_error(F.lit(f"{field.name} must not be NULL")))
            default = None
            if not field.nullable:
                if isinstance(field.dataType, T.TimestampNTZType):
                    raise ValueError(f"the rows have no column {field.name!r}")
                default = "" if isinstance(field.dataType, T.StringType) else 0
            return F.lit(default).cast(field.dataType)

        given = [f for f in fmt.schema.fields if f.name not in ("id", "created_at")]
        complete = rows.select(
            *(stored(f).alias(f.name) for f in [*given, *self._extra_fields(fmt)]),
            *(F.lit(None).cast("string").alias(c) for c in ("file_path", "reason")),
            F.lit(p.PARSED).alias("outcome"),
        )
        return self._save(complete, fmt, fresh).entries

    def _save(
        self, parsed: DataFrame, fmt: LogFormat, fresh: bool = False, rebalance: bool = False,
        origin: str = PLAIN_ORIGIN, ingest: int | None = None,
    ) -> IngestReport:
        if not re.fullmatch(r"\w[\w.-]*", origin, re.ASCII):
            raise ValueError(f"not a plain name of an origin: {origin!r}")
        began = time.monotonic()
        before, folders = self._ingests(fmt), self._folders(fmt)
        mine = folders.get(origin, [])
        number = (mine[-1] + 1 if mine else 0) if ingest is None else ingest
        # What an earlier try of this ingest left does not count.
        older = {**before, origin: [n for n in before.get(origin, []) if n < number]}
        largest = -1 if fresh else self._largest_id(fmt, older)

        rows = parsed.withColumn("log_date", F.to_date("timestamp"))
        if rebalance:
            rows = rows.hint("rebalance", "outcome", "log_date")
        # Ids are given in the stage that writes: a stage run again before a shuffle could
        # number its rows differently, and two rows could end up with one id.
        rows = (
            rows.withColumn("id", F.monotonically_increasing_id() + F.lit(largest + 1))
            .withColumn("created_at", utc_now())
            .select(*(c for c in self._stored_schema(fmt).names if c not in ("origin", "ingest")))
        )
        folder = self._folder(fmt, origin, number)
        # Only a numbered ingest may replace a folder; two plain ones never share theirs.
        mode = "errorifexists" if ingest is None else "overwrite"
        if ingest is not None:
            remove_folder(self.spark, self._summary_folder(fmt, origin, number))
        start = self._begin(fmt, origin, number) if fresh else None
        (
            rows.write.partitionBy(*PARTITIONS).option("partitionOverwriteMode", "static")
            .mode(mode).parquet(folder)
        )
        if fresh:
            self._finish(fmt, start, {o: n for o, n in folders.items() if n}, origin, number)
        seconds = time.monotonic() - began
        # `outcome` is a folder name: the rows are counted without reading any.
        written = self.spark.read.schema("id long, outcome string, log_date date").parquet(folder)
        found = dict(written.groupBy("outcome").count().collect())
        entries, errors = found.get(p.PARSED, 0), found.get(p.REJECTED, 0)
        return IngestReport(
            fmt.name, number, entries + errors, entries, errors, found.get(p.SKIPPED, 0), seconds
        )

    def _begin(self, fmt: LogFormat, origin: str, number: int) -> int:
        """Announce the ingest of a fresh start; the start's number."""
        folder = f"{self.path(fmt)}/_fresh"
        known = [int(n.rpartition("-")[2]) for n in child_files(self.spark, folder) if re.fullmatch(r"(begin|done)-\d+", n)]
        start = max(known, default=-1) + 1
        write_small(self.spark, f"{folder}/begin-{start}", json.dumps([origin, number]))
        return start

    def _finish(self, fmt: LogFormat, start: int, older: dict[str, list[int]], origin: str, number: int) -> None:
        """End all older ingests in favour of the new one, then remove what is over."""
        over = {name: max(n for n in [*numbers, -1] if (name, n) != (origin, number)) for name, numbers in older.items()}
        write_small(self.spark, f"{self.path(fmt)}/_fresh/done-{start}", json.dumps(over))
        for name, numbers in older.items():
            for old in numbers:
                if (name, old) != (origin, number):
                    remove_folder(self.spark, self._folder(fmt, name, old))
                    remove_folder(self.spark, self._summary_folder(fmt, name, old))

    def ingest(
        self, folder: str, fmt: LogFormat | str, globs: str | Sequence[str] | None = None,
        max_depth: int = MAX_DEPTH, fresh: bool = False, rebalance: bool = False,
    ) -> IngestReport:
        """Read every log of a format below a folder and store it."""
        fmt = FORMATS[fmt] if isinstance(fmt, str) else fmt
        lines = read_logs(self.spark, folder, fmt, globs, max_depth)
        return self.write(lines, fmt, fresh=fresh, rebalance=rebalance)

    def ingest_all(
        self, folders: dict[str, str], fresh: bool = False, rebalance: bool = False
    ) -> dict[str, IngestReport]:
        """Ingest one folder per format; the report of each and of all together (`total`)."""
        reports = {
            name: self.ingest(folder, name, fresh=fresh, rebalance=rebalance)
            for name, folder in folders.items()
        }
        counts = [f.name for f in fields(IngestReport) if f.name not in ("format", "ingest")]
        sums = {c: sum(getattr(report, c) for report in reports.values()) for c in counts}
        return {**reports, "total": IngestReport("total", -1, **sums)}

    # --- reading ----------------------------------------------------------------------------

    def table(self, fmt: LogFormat | str) -> DataFrame:
        """The good rows: the declared columns, then what else the format yields, `log_date`."""
        fmt = FORMATS[fmt] if isinstance(fmt, str) else fmt
        return self._shown(self._stored(fmt))

    @staticmethod
    def _shown(stored: DataFrame) -> DataFrame:
        hidden = {"file_path", "reason", "outcome", "origin", "ingest"}
        return stored.where(F.col("outcome") == p.PARSED).select(*(c for c in stored.columns if c not in hidden))

    def quarantine(self, fmt: LogFormat | str) -> DataFrame:
        """Rejected lines and skipped sources with their reason."""
        fmt = FORMATS[fmt] if isinstance(fmt, str) else fmt
        return p.quarantine(self._stored(fmt).where(F.col("outcome") != p.PARSED), fmt)

    def tables(self, *formats: str) -> dict[str, DataFrame]:
        """The good rows of several formats by table name; nginx and Nexus if none is named."""
        chosen = [FORMATS[name] for name in formats or ("nginx", "nexus")]
        return {fmt.table_name: self.table(fmt) for fmt in chosen}

    def register_views(self, *formats: str) -> None:
        """Temporary views: `<table>` and `all_logs` of the good rows, `log_quarantine` of the rest."""
        chosen = [FORMATS[name] for name in formats or ("nginx", "nexus")]
        rejected = None
        for fmt in chosen:
            self.table(fmt).createOrReplaceTempView(fmt.table_name)
            part = self.quarantine(fmt)
            rejected = part if rejected is None else rejected.unionByName(part)
        rejected.createOrReplaceTempView("log_quarantine")
        correlate.all_logs(self.tables(*formats)).createOrReplaceTempView("all_logs")

    def file_statistics(self, fmt: LogFormat | str, files: DataFrame | None = None) -> DataFrame:
        """See `quality.stats_by_file`."""
        fmt = FORMATS[fmt] if isinstance(fmt, str) else fmt
        return quality.stats_by_file(self._stored(fmt), files)

    def statistics(self, *formats: str, files: dict[str, DataFrame] | None = None) -> DataFrame:
        """See `quality.stats_by_format`; nginx and Nexus if no format is named."""
        chosen = [FORMATS[name] for name in formats or ("nginx", "nexus")]
        return quality.stats_by_format({fmt.name: self._stored(fmt) for fmt in chosen}, files)

    def _newest(self, fmt: LogFormat, limit: int) -> DataFrame:
        """The good rows of the newest ingests: of each origin as many as hold `limit` rows.

        Ids grow from ingest to ingest of an origin, so the newest rows are among these. How many rows
        an ingest holds is in its files' footers; older folders are not even listed by the scan.
        """
        wanted = F.lit(False)
        for origin, numbers in self._ingests(fmt).items():
            held, first = 0, None
            for number in reversed(numbers):
                first = number
                rows = self.spark.read.schema("outcome string, log_date date").parquet(self._folder(fmt, origin, number))
                held += rows.where(F.col("outcome") == p.PARSED).count()
                if held >= limit:
                    break
            if first is not None:
                wanted = wanted | ((F.col("origin") == origin) & (F.col("ingest") >= first))
        return self._shown(self._stored(fmt).where(wanted))

    def preview(self, fmt: LogFormat | str, limit: int = 10) -> DataFrame:
        """The newest rows; of the newest ingests the keys are read first, see `catalog.newest`."""
        fmt = FORMATS[fmt] if isinstance(fmt, str) else fmt
        return catalog.preview(self._newest(fmt, limit), fmt.schema, limit, stored=True)

    def sample(self, fmt: LogFormat | str, limit: int = 10) -> DataFrame:
        """The newest rows, all columns."""
        fmt = FORMATS[fmt] if isinstance(fmt, str) else fmt
        return catalog.newest(self._newest(fmt, limit), limit, stored=True)

    # --- summaries --------------------------------------------------------------------------

    def _summary_folder(self, fmt: LogFormat, origin: str, ingest: int) -> str:
        return f"{self.root}/_summaries/{fmt.table_name}/origin={origin}/ingest={ingest}"

    def summaries(self, fmt: LogFormat | str) -> DataFrame:
        """origin, ingest, outcome, log_date, rows, first_time, last_time and a sketch of the clients.

        An ingest without a summary gets one now, from three of its columns; all others are just read.
        """
        fmt = FORMATS[fmt] if isinstance(fmt, str) else fmt
        fields = "rows long, first_time timestamp_ntz, last_time timestamp_ntz, clients binary, outcome string, log_date date, origin string, ingest long"
        folder, wanted = f"{self.root}/_summaries/{fmt.table_name}", F.lit(False)
        has_clients = "ip_address" in fmt.schema.names or any(f.name == "ip_address" for f in self._extra_fields(fmt))
        client = F.col("ip_address") if has_clients else F.lit(None).cast("string")
        there = False
        for origin, numbers in self._ingests(fmt).items():
            for number in numbers:
                there, target = True, self._summary_folder(fmt, origin, number)
                wanted = wanted | ((F.col("origin") == origin) & (F.col("ingest") == number))
                if path_kind(self.spark, f"{target}/_SUCCESS") is None:
                    rows = self.spark.read.schema("ip_address string, timestamp timestamp_ntz, outcome string, log_date date").parquet(
                        self._folder(fmt, origin, number))
                    rows.groupBy("outcome", "log_date").agg(
                        F.count("*").alias("rows"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"),
                        F.hll_sketch_agg(client, F.lit(LG_K)).alias("clients"),
                    ).select("rows", "first_time", "last_time", "clients", "outcome", "log_date").write.mode("overwrite").parquet(target)
        if not there:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).parquet(folder).where(wanted)

    def quick_statistics(self, *formats: str) -> DataFrame:
        """As `catalog.table_statistics`, from summaries alone: no log row is read. `unique_ips` is an
        estimate, off by some 1.6 % as a rule; all else is exact."""
        chosen = [FORMATS[name] for name in formats or ("nginx", "nexus")]
        parts = [
            self.summaries(fmt).where(F.col("outcome") == p.PARSED).agg(
                F.lit(fmt.table_name).alias("table_name"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_entries"),
                F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("clients")), F.lit(0)).alias("unique_ips"),
                F.count_distinct("log_date").alias("unique_days"), F.min("first_time").alias("earliest_log"),
                F.max("last_time").alias("latest_log"))
            for fmt in chosen
        ]
        return reduce(DataFrame.unionByName, parts)

    def ingest_history(self, fmt: LogFormat | str) -> DataFrame:
        """origin, ingest, lines, entries, parse_errors, skipped and success rate of each ingest, from summaries."""
        def rows(outcome: str) -> Column:
            return F.coalesce(F.sum(F.when(F.col("outcome") == outcome, F.col("rows"))), F.lit(0)).cast("long")

        counted = self.summaries(fmt).groupBy("origin", "ingest").agg(
            rows(p.PARSED).alias("entries"), rows(p.REJECTED).alias("parse_errors"), rows(p.SKIPPED).alias("skipped"))
        lines = F.col("entries") + F.col("parse_errors")
        return counted.withColumn("lines", lines).withColumn("success_rate", quality.success_rate(F.col("entries"), F.col("lines")))

    def time_range(
        self, fmt: LogFormat | str, start: dt.datetime, end: dt.datetime, limit: int = 100
    ) -> DataFrame:
        """The newest requests of a time range; only the days of the range are read."""
        fmt = FORMATS[fmt] if isinstance(fmt, str) else fmt
        query = traffic.nexus_time_range if fmt.name == "nexus" else traffic.nginx_time_range
        return query(self.table(fmt), start, end, limit)
