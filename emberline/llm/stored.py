"""Intermediate tables in the shared folder, so lost executors cost no recomputation and lineage stays short."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_folder


def stored(df: DataFrame, dictionary: bool = True) -> DataFrame:
    """``df`` written as Parquet to a new folder below ``spark.checkpoint.dir`` and read again; rows of long arrays need no ``dictionary``."""
    spark = df.sparkSession
    folder = scratch_folder(spark)
    df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def dropped(*frames: DataFrame) -> None:
    """Delete the folders of frames made by ``stored`` that no later step reads."""
    for frame in frames:
        spark = frame.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            assert folder.rsplit("/", 1)[1].startswith("scratch-"), folder
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, files of a shuffle go with the action that made them; without, they stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    configured = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, configured)
