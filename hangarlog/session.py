"""Session settings this library is designed for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # HotSpot never compiles a method above 8000 bytes of bytecode. A projection
    # that long is better split into smaller methods than fused into one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


#: Bytes that a shuffle partition should hold at the start; AQE merges smaller ones.
PARTITION_BYTES = 128 << 20


def shuffle_partitions(input_bytes: int, least: int = 200) -> int:
    """A starting number of shuffle partitions for an input of this size.

    AQE merges partitions but never makes more, so a large input needs enough
    of them from the start: pass the result as
    spark.sql.adaptive.coalescePartitions.initialPartitionNum.
    """
    return max(least, -(-input_bytes // PARTITION_BYTES))


def build_session(app_name: str = "hangarlog", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder reliable checkpoints go to.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only where
    neither that setting nor a directory on the context exists, as in a local
    test, is a temporary folder used.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="hangarlog-checkpoint-")
    context.setCheckpointDir(configured)
    return configured
