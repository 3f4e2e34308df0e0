"""Session construction and lineage control."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "leafspan", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Build a session with the settings every operator assumes.

    Cluster deployments pass no ``master`` and size ``spark.sql.shuffle.partitions`` themselves; AQE
    coalesces partitions that turn out small and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; fall back to a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="leafspan-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so that an iterative plan stays short and survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_stage(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` after which the files that only ``df`` needed go, for stages that move much.

    The rows are made by a plan of its own, which holds the shuffle files and ends here; without it they would stay as long as
    the caller keeps ``df``. Spark removes files once the driver has collected its garbage, which also keeps its heap small; what the
    last job still holds goes with the next stage.
    """
    made = cut_lineage(df.select("*"))
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return made


def cut_round(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` for results that come round again in a loop.

    A checkpoint keeps the size estimate of its plan, in which joins multiply sizes; over rounds that number grows to megabytes
    of digits in the driver. The rows are cached first, so that their measured size is kept instead.
    """
    cached = df.persist()
    try:
        cached.count()
        return cut_lineage(cached.select("*"))
    finally:
        cached.unpersist()
