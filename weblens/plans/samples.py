"""Access-log lines made from the `events` table, one line per event.

The text of each expression is kept neutral: `{STR}` is the string type and `{CLF}`, `{CLF1}`
and `{ISO}` are the event time (`{CLF1}` a second later) in the two log notations, so that
another SQL engine can make the same lines for a comparison.
"""

from __future__ import annotations

import bz2
import gzip
import io
import re
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weblens.session import file_system, shared_folder

SPARK_DIALECT = {
    "STR": "STRING",
    "CLF": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
    "CLF1": "date_format(ts + INTERVAL '1' SECOND, 'dd/MMM/yyyy:HH:mm:ss')",
    "ISO": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
}

CLIENT = "concat('10.', CAST(user_id % 4 AS {STR}), '.0.', CAST(user_id % 250 AS {STR}))"
STATUS = ("CASE event_type WHEN 'error' THEN '500' WHEN 'click' THEN '404'"
          " WHEN 'view' THEN '200' ELSE '201' END")

NGINX_LINES = {
    "file_source": f"""concat('nginx:access.log.', CAST(event_id % 4 AS {{STR}}))""",
    "line": f"""CASE
    WHEN event_id % 97 = 0 THEN 'not a valid log line'
    WHEN event_id % 103 = 0 THEN ''
    ELSE concat({CLIENT}, ' ',
      CASE WHEN event_id % 5 = 0 THEN concat('user', CAST(user_id AS {{STR}})) ELSE '-' END,
      ' ', CASE WHEN event_id % 8 = 0 THEN concat('login', CAST(user_id AS {{STR}})) ELSE '-' END,
      ' [', CASE WHEN event_id % 101 = 0 THEN 'bad-time' ELSE concat({{CLF}}, ' +0000') END, '] "',
      CASE event_id % 20
        WHEN 0 THEN 'SSH-2.0-Go'
        WHEN 1 THEN '{{{{x22id:1,x22method:eth_getWork}}}}'
        WHEN 2 THEN repeat('x', 100)
        WHEN 3 THEN concat('GET /test', chr(1), 'BAD')
        WHEN 4 THEN concat('GET /noversion/', event_type)
        ELSE concat(CASE event_id % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'PUT' ELSE 'GET' END,
          ' /repository/', event_type, '/', CAST(user_id AS {{STR}}), ' HTTP/1.1')
      END, '" ', {STATUS}, ' ',
      CASE WHEN event_id % 11 = 0 THEN '-' ELSE CAST(event_id * 7 % 100000 AS {{STR}}) END, ' "',
      CASE WHEN event_id % 2 = 0 THEN '-' ELSE 'https://example.com/' END, '" "',
      CASE WHEN event_id % 6 = 0 THEN '-' ELSE concat('agent/', CAST(user_id % 9 AS {{STR}})) END,
      '"')
  END""",
}

NEXUS_LINES = {
    "file_source": f"""concat('nexus:request.log.', CAST(event_id % 3 AS {{STR}}))""",
    "line": f"""CASE
    WHEN event_id % 89 = 0 THEN 'completely invalid log format'
    ELSE concat({CLIENT}, ' - ',
      CASE WHEN event_id % 4 = 0 THEN '-' ELSE concat('user', CAST(user_id AS {{STR}})) END,
      ' [', CASE WHEN event_id % 91 = 0 THEN 'bad-time' ELSE concat({{CLF1}}, ' +0000') END, '] "',
      CASE event_id % 5 WHEN 0 THEN 'PUT' WHEN 1 THEN 'DELETE' WHEN 2 THEN 'HEAD'
        WHEN 3 THEN 'POST' ELSE 'GET' END,
      CASE WHEN event_id % 7 = 0 THEN ' /service/metrics/ping'
        ELSE concat(' /repository/', event_type, '/', CAST(user_id AS {{STR}})) END,
      ' HTTP/1.1" ', {STATUS}, ' ',
      CASE WHEN event_id % 11 = 0 THEN '-' ELSE CAST(event_id * 13 % 100000 AS {{STR}}) END, ' ',
      CASE WHEN event_id % 13 = 0 THEN '-' ELSE CAST(event_id * 3 % 5000 AS {{STR}}) END, ' ',
      CASE WHEN event_id % 17 = 0 THEN '-' ELSE CAST(event_id % 900 AS {{STR}}) END,
      CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' ""'
        ELSE concat(' "agent/', CAST(user_id % 9 AS {{STR}}), '"') END,
      CASE WHEN event_id % 9 = 0 THEN ' '
        ELSE concat(' [qtp', CAST(user_id AS {{STR}}), '-', CAST(event_id % 50 AS {{STR}}), ']') END)
  END""",
}

CUSTOM_SERVICE_LINES = {
    "file_source": f"""'custom_service:service_api.log'""",
    "line": f"""CASE
    WHEN event_id % 83 = 0 THEN 'invalid log format'
    WHEN event_id % 79 = 0 THEN '2024-02-31 10:00:00 [INFO] impossible day'
    ELSE concat({{ISO}}, CASE event_id % 4
      WHEN 0 THEN concat(' [INFO] user', CAST(user_id AS {{STR}}), ' accessed /api/', event_type,
        ' - response_time: ', CAST(event_id % 700 AS {{STR}}), 'ms')
      WHEN 1 THEN concat(' [INFO] user', CAST(user_id AS {{STR}}), ' accessed /', event_type)
      WHEN 2 THEN concat(' [ERROR] ', event_type, '_failed for user', CAST(user_id AS {{STR}}),
        ' from ', {CLIENT})
      ELSE ' [WARN] nothing in particular  ' END)
  END""",
}

NEXUS_STAMPS = {
    "stamp": """CASE event_id % 7
    WHEN 0 THEN concat({CLF}, ' +0000')
    WHEN 1 THEN concat({ISO}, ',123+0000')
    WHEN 2 THEN concat({ISO}, '+0400')
    WHEN 3 THEN concat({ISO}, '-0500')
    WHEN 4 THEN {ISO}
    WHEN 5 THEN 'not-a-valid-timestamp'
    ELSE concat('31/Feb/2024:10:00:', CAST(event_id % 60 AS {STR}))
  END""",
}

SAMPLES = {
    "nginx": NGINX_LINES,
    "nexus": NEXUS_LINES,
    "custom_service": CUSTOM_SERVICE_LINES,
    "stamps": NEXUS_STAMPS,
}


def expressions(name: str, dialect: dict[str, str]) -> list[str]:
    """The columns of a sample in a dialect. Braces of the lines themselves are doubled."""
    columns = SAMPLES[name].items()
    return ["event_id", *(f"{text.format(**dialect)} AS {column}" for column, text in columns)]


def sample_lines(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lines of a format (`line`, `event_id`, `file_source`) from the events below `sf_dir`."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = events.selectExpr(*expressions(name, SPARK_DIALECT))
    text = made.columns[-1]
    # A filter on the text stays above explode(), so each text is put together only once.
    return made.select(*made.columns[:-1], F.explode(F.array(text)).alias(text))


def packed(lines: DataFrame, member: str) -> DataFrame:
    """The lines as gzipped tar archives (`name`, `path`, `content`), some thousand lines each.

    Rows of `line` become the member of an archive made where the rows are.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = "\n".join(batch.column("line").to_pylist()).encode()
            packed_bytes = io.BytesIO()
            with tarfile.open(fileobj=packed_bytes, mode="w:gz") as tar:
                info = tarfile.TarInfo(f"logs/{member}")
                info.size = len(text)
                tar.addfile(info, io.BytesIO(text))
            name = f"{member}.tar.gz"
            yield pa.RecordBatch.from_pydict(
                {"name": [name], "path": [f"/sample/{uuid.uuid4()}/{name}"],
                 "content": [packed_bytes.getvalue()]}
            )

    return lines.select("line").mapInArrow(pack, "name string, path string, content binary")


#: Lines of a sample file.
FILE_LINES = 1000


def _tar(members: list[tuple[str, bytes | str]], mode: str = "w") -> bytes:
    """A tar of members in order; a text in place of bytes makes a link to the member it names."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, content in members:
            info = tarfile.TarInfo(name)
            if isinstance(content, str):
                info.type, info.linkname = tarfile.SYMTYPE, content
                tar.addfile(info)
            else:
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
    return out.getvalue()


def _zip(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in members:
            archive.writestr(name, content)
    return out.getvalue()


def _sample_file(kind: str, number: int, lines: list[str]) -> tuple[str, bytes]:
    """Name and content of the file that holds some lines, the even ones apart from the odd ones."""
    even, odd = ("\n".join(lines[k::2]).encode() for k in (0, 1))
    whole = "\n".join(lines).encode()
    if kind == "zip":
        return f"access.log.{number}.zip", _zip([("logs/access.log", even), ("notes.txt", b"no log"), ("ACCESS.LOG.1", odd)])
    if kind == "nested":
        inner = _tar([("access.log.zip", _zip([("access.log", even)])), ("error.log", b"no")], "w:gz")
        return f"access.log.{number}.tar", _tar([("old/access.log.tar.gz", inner), ("access.log.1.gz", gzip.compress(odd))])
    if kind == "damaged":
        packed = gzip.compress(whole)
        return f"access.log.{number}.gz", packed[:len(packed) // 2] if number % 3 == 0 else packed
    if kind == "links":
        whole_tar = _tar(
            [("access.log", even), ("access.log.current", "access.log"), ("access.log.gone", "nothing"),
             ("../access.log", odd), ("access.log.1", odd), ("./access.log.1", even)])
        # At once and in the smallest blocks: repeated members in a larger block take longest to sort.
        return f"access.log.{number}.tar.bz2", bz2.compress(whole_tar, 1)
    if kind == "mixed":
        return (f"ACCESS.Log.{number}", f"Other-{number}.log", f"error.log.{number}")[number % 3], whole
    if kind == "hidden":
        return (f"access.log.{number}", f"_old/access.log.{number}", f".arch/_deep/access.log.{number}")[number % 3], whole
    if kind == "broken":
        return f"access.log.{number}", whole.replace(b"/repository/", b"/repository/\xff\xc3")
    raise ValueError(f"no such kind of sample files: {kind!r}")


def sample_files(lines: DataFrame, kind: str) -> DataFrame:
    """The lines as files (`name`, `content`), FILE_LINES events each."""
    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("event_id")
        name, content = _sample_file(kind, table["number"][0].as_py(), table["line"].to_pylist())
        return pa.table({"name": pa.array([name]), "content": pa.array([content], pa.binary())})

    numbered = lines.select("event_id", "line", F.expr(f"CAST(event_id DIV {FILE_LINES} AS INT)").alias("number"))
    return numbered.groupBy("number").applyInArrow(make, "name string, content binary")


#: Files that are given their names at the same time.
RENAMES = 16
#: Fixed value: the ends of names of packed files.
_PACKED = r"\.(zip|gz|bz2|tar)$"


def write_files(files: DataFrame) -> str:
    """A folder in which each row of `name` and `content` is a file.

    Behind the bytes stands a zero byte where they are packed, which archives may end with, else a line feed.
    In a folder of the machine's own file system tasks write the files themselves, elsewhere Spark's text writer does.
    """
    folder = shared_folder(files.sparkSession, "files")
    path, system = file_system(files.sparkSession, folder)
    if system.getUri().getScheme() == "file":
        _write_by_tasks(files, path.toUri().getPath())
    else:
        _write_by_spark(files, folder)
    return folder


def _write_by_tasks(files: DataFrame, folder: str) -> None:
    """A file is there as a whole or not at all: written aside, then renamed, so a task may run again."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                place = Path(folder, name)
                place.parent.mkdir(parents=True, exist_ok=True)
                aside = place.with_name(f".{uuid.uuid4().hex}")
                with open(aside, "wb") as out:
                    out.write(content.as_buffer())
                    out.write(b"\0" if re.search(_PACKED, name) else b"\n")
                aside.replace(place)
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    files.select("name", "content").mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


def _write_by_spark(files: DataFrame, folder: str) -> None:
    """Rows are made once and kept for both ends; tasks put their files in place, which else the driver would do one by one."""
    spark = files.sparkSession
    written, kept = shared_folder(spark, "written"), shared_folder(spark, "packed")
    numbered = files.select(F.hex("name").alias("name"), F.col("content").cast("string").alias("value"), F.col("name").rlike(_PACKED).alias("packed"))
    numbered.write.partitionBy("packed").parquet(kept)
    again = spark.read.schema(numbered.schema).parquet(kept)
    for packed, end in ((True, "\0"), (False, "\n")):
        part = again.where(F.col("packed") == packed).drop("packed")
        writer = part.write.mode("append").partitionBy("name").option("lineSep", end)
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(written)
    _give_names(spark, written, folder)


def _give_names(spark: SparkSession, written: str, folder: str) -> None:
    """Rename what lies below `written` in a folder per name, found by Spark's listing, to that name in `folder`."""
    system = file_system(spark, folder)[1]
    path = spark._jvm.org.apache.hadoop.fs.Path
    # The end of each path, the folder of the name and the file in it, is plain text in any notation.
    ends = [found.split("/")[-2:] for found in spark.read.format("binaryFile").load(written).inputFiles()]
    moves = [(f"{written}/{child}/{part}", f"{folder}/{bytes.fromhex(child.removeprefix('name=')).decode()}") for child, part in ends]
    for parent in {target.rpartition("/")[0] for _, target in moves}:
        system.mkdirs(path(parent))

    def move(pair: tuple[str, str]) -> None:
        source, target = pair
        if not system.rename(path(source), path(target)):
            raise OSError(f"could not rename {source} to {target}")

    with ThreadPoolExecutor(RENAMES) as pool:
        for _ in pool.map(move, moves):
            pass
