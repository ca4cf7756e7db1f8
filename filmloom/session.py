"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(app_name: str = "filmloom", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution on. Partition counts are left to AQE and to the cluster."""
    builder = (SparkSession.builder.appName(app_name)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC"))
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package; a no-op once it has been shipped."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='filmloom-')}/filmloom", "zip",
                                  root_dir=package.parent, base_dir=package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers in bytes, unless the session sets that bound itself.

    Spark's own bound is ten thousand rows, tens of MB of long texts that a worker would hold several times over.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, "1m")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local session may fall back to a folder of this machine, since executors of a cluster
    would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_scratch:
        _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="filmloom-")
        context.setCheckpointDir(_local_scratch[context.applicationId])
    return _local_scratch[context.applicationId]


def new_dir(spark: SparkSession, label: str) -> str:
    """A path that does not exist yet, below the shared scratch folder."""
    return f"{scratch_root(spark)}/filmloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once, read back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cores: a file of one row group is read by one task, and what follows would stay in it.

    Two tasks a core, since a task that evaluates large expressions takes seconds before its first row.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
