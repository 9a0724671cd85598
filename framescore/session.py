"""Session settings and the one way jobs cut lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# AQE coalesces small shuffles, splits skewed join partitions and turns a join
# into a broadcast only after it has measured the side that would be sent.
SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # No stack trace per column expression: plans with many of them build faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app_name: str = "framescore",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with ``SCALE_CONF``; ``conf`` wins over it, ``master`` is for tests."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SCALE_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

# Per application: its temporary folder in local mode, and whether it has the package.
_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A session in local mode that names none gets a temporary folder; on a cluster
    a missing setting is an error, since a machine's own disk goes with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="framescore-")
    return _LOCAL_DIRS[context.applicationId]


def new_shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/framescore-{tag}-{uuid.uuid4().hex}"


def shuffle_tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_lineage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later jobs see fixed rows whatever executors are lost meanwhile, and prune
    columns and count bytes as for any other Parquet table. The folder keeps the table
    until it is cleared, as it does with Spark's own checkpoints.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for its pandas UDFs.

    Batches of rows that go to Python are bounded by bytes too, unless the session says how: rows may be long texts or pixels.
    """
    if spark.conf.get(BATCH_BYTES, None) in (None, str(2**63 - 1)):
        spark.conf.set(BATCH_BYTES, str(1 << 24))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = f"{tempfile.mkdtemp(prefix='framescore-code-')}/{root.name}-{uuid.uuid4().hex}"
        context.addPyFile(shutil.make_archive(archive, "zip", root.parent, root.name))
        _SHIPPED.add(context.applicationId)
