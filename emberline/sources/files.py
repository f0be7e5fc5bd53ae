"""File scans of the seven raw log layouts, and the registry that selects them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import RAW_SCHEMA
from . import formats


def _hadoop_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _hadoop_path(spark, path)
    return fs.exists(jpath)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted file paths matching a glob, on whatever file system holds them."""
    jpath, fs = _hadoop_path(spark, pattern)
    found = fs.globStatus(jpath) or []
    return sorted(s.getPath().toString() for s in found if s.isFile())


def list_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted folders matching a glob."""
    jpath, fs = _hadoop_path(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(jpath) or [] if s.isDirectory())


def folder_files(spark: SparkSession, folder: str) -> list[str]:
    """Files directly in a folder (whose name is no pattern); none where it is missing."""
    jpath, fs = _hadoop_path(spark, folder)
    return [s.getPath().toString() for s in fs.listStatus(jpath) if s.isFile()] if fs.exists(jpath) else []


def delete_path(spark: SparkSession, path: str) -> None:
    jpath, fs = _hadoop_path(spark, path)
    fs.delete(jpath, True)


def date_files(spark: SparkSession, paths: list[str]) -> None:
    """Sets the files' times of change one millisecond after another, in the order given, the last one now: streams read files by them."""
    now = int(time.time() * 1000)
    for i, path in enumerate(paths):
        jpath, fs = _hadoop_path(spark, path)
        fs.setTimes(jpath, now - len(paths) + 1 + i, -1)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Renames; the folder above the target is made where it is missing."""
    jpath, fs = _hadoop_path(spark, source)
    to, _ = _hadoop_path(spark, target)
    fs.mkdirs(to.getParent())
    if not fs.rename(jpath, to):
        raise OSError(f"could not move {source} to {target}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    jpath, fs = _hadoop_path(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written over where it exists."""
    jpath, fs = _hadoop_path(spark, path)
    out = fs.create(jpath, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file, which is there whole or not at all; False where one of that name exists already."""
    jvm, (target, fs) = spark._jvm, _hadoop_path(spark, path)
    attempt = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(attempt)
    out.write(bytearray(text.encode()))
    out.close()
    never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never_over[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(attempt), fs.makeQualified(target), never_over)
    except Py4JJavaError as error:
        fs.delete(attempt, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def read_lines(spark: SparkSession, paths: str | list[str], recursive: bool = False,
               glob: str | None = None) -> DataFrame:
    """Text lines with bad bytes replaced, plus the file and folder they came from."""
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    parts = F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/")
    return reader.text(paths).select(
        F.make_valid_utf8("value").alias("value"),
        F.element_at(parts, -1).alias("file_name"),
        F.element_at(parts, -2).alias("folder"),
    )


def _no_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RAW_SCHEMA)


def _entries_only(df: DataFrame) -> DataFrame:
    return df.select(*RAW_SCHEMA.names)


def scan_linux(spark: SparkSession, data_dir: str, reference_year: int, **_) -> DataFrame:
    path = f"{data_dir}/Linux.log"
    if not path_exists(spark, path):
        return _no_entries(spark)
    return _entries_only(formats.parse_linux(read_lines(spark, path), reference_year))


def scan_ssh(spark: SparkSession, data_dir: str, reference_year: int, **_) -> DataFrame:
    path = f"{data_dir}/SSH.log"
    if not path_exists(spark, path):
        return _no_entries(spark)
    return _entries_only(formats.parse_ssh(read_lines(spark, path), reference_year))


def scan_hadoop(spark: SparkSession, data_dir: str, **_) -> DataFrame:
    """Every ``*.log`` below ``hadoop/``; the host is the folder of the file."""
    path = f"{data_dir}/hadoop"
    if not path_exists(spark, path):
        return _no_entries(spark)
    lines = read_lines(spark, path, recursive=True, glob="*.log").withColumnRenamed("folder", "host")
    return _entries_only(formats.parse_hadoop(lines))


def scan_spark_app(spark: SparkSession, data_dir: str, **_) -> DataFrame:
    """Every file directly in ``spark/``; the host is the file name."""
    files = list_paths(spark, f"{data_dir}/spark/*")
    if not files:
        return _no_entries(spark)
    lines = read_lines(spark, files).withColumnRenamed("file_name", "host")
    return _entries_only(formats.parse_spark_app(lines))


def scan_bgl(spark: SparkSession, data_dir: str, include_alerts: bool = False, **_) -> DataFrame:
    path = f"{data_dir}/supercomputer/BGL.log"
    if not path_exists(spark, path):
        return _no_entries(spark)
    return _entries_only(formats.parse_bgl(read_lines(spark, path), include_alerts))


def scan_hdfs_trace(spark: SparkSession, data_dir: str, batch_time: str, **_) -> DataFrame:
    """Task tables of event counts; which of the two files holds a row decides its level."""
    out = []
    for name, failed in (("normal_trace.csv", False), ("failure_trace.csv", True)):
        path = f"{data_dir}/HDFS TraceBench/preprocessed/{name}"
        if path_exists(spark, path):
            rows = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
            if rows.columns:
                out.append(formats.parse_hdfs_trace(rows, rows.columns[0], rows.columns[1:], batch_time, F.lit(failed)))
    return _entries_only(reduce(DataFrame.unionByName, out)) if out else _no_entries(spark)


def android_path(spark: SparkSession, data_dir: str) -> str | None:
    """First file present of: the top-level one, the folder's own, any other in the folder."""
    wanted = [f"{data_dir}/Android.log", f"{data_dir}/Android/Android.log"]
    for path in wanted:
        if path_exists(spark, path):
            return path
    others = list_paths(spark, f"{data_dir}/Android/*.log")
    return others[0] if others else None


def scan_android(spark: SparkSession, data_dir: str, reference_year: int, **_) -> DataFrame:
    path = android_path(spark, data_dir)
    if path is None:
        return _no_entries(spark)
    return _entries_only(formats.parse_android(read_lines(spark, path), reference_year))


SCANS: dict[str, Callable[..., DataFrame]] = {
    "linux": scan_linux,
    "ssh": scan_ssh,
    "hadoop": scan_hadoop,
    "spark": scan_spark_app,
    "supercomputer": scan_bgl,
    "hdfs": scan_hdfs_trace,
    "android": scan_android,
}


def register_format(name: str, scan: Callable[..., DataFrame]) -> None:
    """Adds a source: ``scan(spark, data_dir, **params)`` returns log entries."""
    SCANS[name] = scan


def read_all_sources(spark: SparkSession, data_dir: str, sources: list[str], **params) -> DataFrame:
    """Union of the named sources; unknown names are skipped, none known is an error."""
    known = [name for name in sources if name in SCANS]
    if not known:
        raise ValueError(f"No valid sources in {sources}")
    return reduce(DataFrame.unionByName, [SCANS[name](spark, data_dir, **params) for name in known])
