"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


# Recommended on any cluster.
TUNING = {
    # The JVM leaves methods beyond 8000 bytes uncompiled; wide projections, such as
    # the typing of all measures, are then better split than fused into one stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Joins whose build side proves small in every partition need no sort of the wide side.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def local_session(cores: int | str = "*", **conf) -> SparkSession:
    """Session for tests and benches; on a cluster the submitter configures its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loantide")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**TUNING, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir`` or set as the context's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def task_count(spark: SparkSession, per_core: int = 2) -> int:
    """Partitions for CPU-bound work on few bytes, where sizing by bytes would give one and the shuffle setting far too many."""
    return per_core * spark.sparkContext.defaultParallelism
