"""Session construction, checkpoint folder and the size check in front of every broadcast."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is hinted as broadcast only while its estimated bytes stay under this bound.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(app: str = "corpusmill", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="corpusmill-src-")
    archive = shutil.make_archive(
        os.path.join(folder, "corpusmill_src"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, taking the cluster's setting when there is one.

    A machine-local folder is used only on a local master, where no setting was given.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="corpusmill-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once, compressed, below the checkpoint folder and read it back; the files go when the session ends."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate; runs no job."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def widen(df: DataFrame, key: str, task_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Spread a small input over all cores before expensive per-row work.

    A small file arrives as one or two splits, which would leave the work to as many tasks. Inputs
    with at least ``task_bytes`` per core already have splits enough and are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if estimated_bytes(df) < cores * task_bytes else df


def deal(df: DataFrame, key: str, source: DataFrame, task_bytes: int = 8 * 1024 * 1024) -> DataFrame:
    """Hash rows by ``key`` into as many partitions as their ``source`` has lots of ``task_bytes`` (as it is stored), one per core at least.

    For steps whose rows multiply inside a task: what a task holds then does not grow with the input. A given number is also
    not merged by adaptive execution, which sees the bytes in front of the step only.
    """
    spark = df.sparkSession
    # Of the leaves: Catalyst takes the product of both sides as the size of a join.
    leaves = source._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(size for size in sizes if size < 1 << 50)
    lots = -(-known // task_bytes) if known else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(spark.sparkContext.defaultParallelism, lots), key)


def bounded_broadcast(
    side: DataFrame, source: DataFrame, growth: float = 1.0, limit: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """Hint ``side`` as broadcast only if ``source`` (which bounds it) is provably small.

    ``growth`` is the largest factor by which ``side`` can exceed ``source``. Beyond the limit the
    frame is returned without a hint and the join is planned as a shuffled join, which adaptive
    execution may still split on skewed keys.
    """
    return F.broadcast(side) if estimated_bytes(source) * growth <= limit else side
