"""Intermediate tables: written once to shared storage, then read column by column.

A fit that makes several passes over an expensive plan would recompute that plan every
pass. Writing it as Parquet cuts the lineage, survives the loss of executors, and keeps
column pruning and filter pushdown for the later passes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_written: dict[str, list[str]] = {}
_local_roots: dict[str, tempfile.TemporaryDirectory] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder.

    Only a local session without that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get(_CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.TemporaryDirectory(
            prefix="buyerscope-", ignore_cleanup_errors=True
        )
    return _local_roots[context.applicationId].name


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that was written."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> int:
    """Delete the intermediate tables this application has written; frames that read them end here."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
    return len(paths)
