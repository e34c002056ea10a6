"""Spark session helpers.

The library never builds its own session inside an operator: every operator
takes DataFrames and returns a DataFrame.  These helpers are for scripts,
tests and the bench, and for reading cluster-level settings (the shared
checkpoint folder) from whatever session the caller hands in.
"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job in this package relies on.  AQE re-plans joins and
# shuffle partition counts at run time and splits skewed join partitions;
# UTC keeps date arithmetic identical to the SQL oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files of frames the driver no longer references (percentile
    # and position sorts) are deleted, so a long-running service does not
    # fill the shared folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Bytes per scan split and per shuffle partition after coalescing: large
# enough to amortise task start-up, small enough that one partition's sort or
# hash-aggregation buffers fit in a core's share of executor memory.
SPLIT_BYTES = 256 * 1024 * 1024
SHUFFLE_PARTITION_BYTES = 128 * 1024 * 1024
# Shuffle data is far smaller than the input once the click stream is
# partially aggregated; the initial count is an upper bound AQE coalesces.
INPUT_BYTES_PER_SHUFFLE_PARTITION = 1024 * 1024 * 1024
MAX_SHUFFLE_PARTITIONS = 100_000


def scale_conf(input_bytes: int, total_cores: int, max_shuffle_partitions: int = MAX_SHUFFLE_PARTITIONS) -> dict[str, str]:
    """Settings sized to the input and the cluster (pass to ``get_session``).

    Scans split at ``SPLIT_BYTES``; the initial shuffle partition count gives
    every core at least two waves and about one partition per GiB of input, up to
    ``max_shuffle_partitions`` (map-output bookkeeping grows with the count); AQE coalesces toward
    ``SHUFFLE_PARTITION_BYTES`` and splits join partitions five times larger.
    """
    parts = max(2 * total_cores, math.ceil(input_bytes / INPUT_BYTES_PER_SHUFFLE_PARTITION))
    parts = min(parts, max_shuffle_partitions)
    return {
        "spark.sql.files.maxPartitionBytes": str(SPLIT_BYTES),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(5 * SHUFFLE_PARTITION_BYTES),
    }


def get_session(
    app_name: str = "cohortlens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra_conf: dict | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    ``master`` is only set when given; on a cluster the launcher decides it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # Local mode runs everything in the driver JVM.
        conf["spark.driver.memory"] = os.environ.get("COHORTLENS_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this setting names storage every executor can reach, so
    lineage cuts and streaming state survive the loss of any executor.  In
    local mode an unset folder is a temporary one of this machine, recorded in
    the session so later calls agree, and removed when the driver ends.
    Elsewhere an unset folder is an error: executors would write to their own disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it an action's shuffle files go as soon as it ends, not when the driver happens to collect its garbage.

    For steps that write what later ones read; the caller's setting is put back.
    """
    own = spark.conf.get(RELEASE)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, own)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, in this application's folder under the shared checkpoint folder.

    The folder goes when the driver ends.
    """
    context = spark.sparkContext
    folder = f"{shared_checkpoint_dir(spark)}/cohortlens-{context.applicationId}"
    if getattr(context, "_cohortlens_scratch", None) != folder:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        context._cohortlens_scratch = folder
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
