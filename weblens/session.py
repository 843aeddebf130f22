"""Session helpers: a tuned session for stand-alone use, and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that matter for this workload. A session handed in by the caller is never changed.
#: Keeping several partition writers open spares the sort of whole rows by partition column
#: that a dynamic-partition write needs otherwise; a log file rarely spans many days.
TUNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def session(master: str | None = None, app: str = "weblens", **conf: str) -> SparkSession:
    """A session with the workload's settings; extra settings as keywords, dots as `__`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in TUNED.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the cluster's shared folder (`spark.checkpoint.dir`).

    Only where that setting is absent and Spark runs in this process, a temporary folder stands in
    for it; executors on other machines would not see that one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder for master {master!r}")
        root = tempfile.mkdtemp(prefix="weblens-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The path as the JVM has it, and its own file system."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_kind(spark: SparkSession, path: str) -> str | None:
    """`file` or `folder` as the path's own file system sees it; None where there is nothing."""
    jvm_path, system = file_system(spark, path)
    if not system.exists(jvm_path):
        return None
    return "folder" if system.getFileStatus(jvm_path).isDirectory() else "file"


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a folder; none where there is no such folder."""
    jvm_path, system = file_system(spark, path)
    if not system.exists(jvm_path):
        return []
    return [found.getPath().getName() for found in system.listStatus(jvm_path) if found.isDirectory()]


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm_path, system = file_system(spark, path)
    system.delete(jvm_path, True)


def child_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly below a folder; none where there is no such folder."""
    jvm_path, system = file_system(spark, path)
    if not system.exists(jvm_path):
        return []
    return [found.getPath().getName() for found in system.listStatus(jvm_path) if found.isFile()]


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    jvm_path, system = file_system(spark, path)
    stream = system.open(jvm_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def rename(spark: SparkSession, path: str, to: str) -> None:
    jvm_path, system = file_system(spark, path)
    if not system.rename(jvm_path, file_system(spark, to)[0]):
        raise OSError(f"could not rename {path} to {to}")


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all: written aside, then renamed."""
    jvm_path, system = file_system(spark, path)
    aside = file_system(spark, f"{path}.{uuid.uuid4().hex}")[0]
    stream = system.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not system.rename(aside, jvm_path):
        raise OSError(f"could not rename {aside} to {jvm_path}")
