"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Arrow batches between Spark and Python end at this size, whatever the length of their texts.
ARROW_BYTES = 8 << 20

#: Tasks a core that ``dealt`` makes.
DEALT_TASKS = 4

_shipped: set[str] = set()


def build_session(app: str = "emberline", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with AQE on and a UTC clock; cluster settings win where given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "snappy")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that results depend on (log times are UTC), and give executors this package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    ship_code(spark.sparkContext)
    return spark


def ship_code(sc: SparkContext) -> None:
    """Add this package to the application's Python files once, so executors need no install.

    The archive is served from the driver for as long as the driver runs; only code is in it.
    """
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="emberline-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = os.path.dirname(os.path.abspath(__file__))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "emberline"), "zip", os.path.dirname(package), "emberline"))
    _shipped.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession, default: str | None = None) -> str:
    """The shared folder the cluster names; ``default`` only where it names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if default is None:
        raise ValueError("spark.checkpoint.dir is unset: name a folder all executors can reach")
    return default


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        local = None
        if sc.master.startswith("local") and not spark.conf.get("spark.checkpoint.dir", None):
            local = tempfile.mkdtemp(prefix="emberline-checkpoint-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
        sc.setCheckpointDir(checkpoint_dir(spark, local))
    return sc.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an intermediate that several later passes read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by a hash of ``by`` over a few tasks a core: a table of few, dense row groups is read by as few tasks, however many rows it has.

    Costs a shuffle, so it is for rows that much work follows on; ``by`` should tell most rows apart.
    """
    return rows.repartition(DEALT_TASKS * rows.sparkSession.sparkContext.defaultParallelism, *by)


def scratch_folder(spark: SparkSession) -> str:
    """A new, empty path in the shared folder."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
