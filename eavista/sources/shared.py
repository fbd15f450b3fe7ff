"""Shared storage for intermediate results, and size estimates for plan choices."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    configured = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="eavista-")
    context.setCheckpointDir(folder)
    return folder


def materialized(frame: DataFrame) -> DataFrame:
    """``frame`` computed once into reliable storage, so later uses do not repeat its scans."""
    spark = frame.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """``frame`` computed once into the shared folder and read from there, where Spark knows its size."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which Spark broadcasts a table by itself."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def estimated_bytes(frame: DataFrame) -> int:
    """Spark's own size estimate for ``frame``."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(frame: DataFrame) -> bool:
    """Whether Spark would broadcast ``frame`` under the session's threshold."""
    return estimated_bytes(frame) <= broadcast_limit(frame.sparkSession)
