"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that matter for large tables: runtime re-planning, coalescing of small
# shuffle blocks, and splitting of skewed join partitions. Broadcasts are left to
# Spark, which checks the side's measured size against its threshold.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(
    app_name: str = "buyerscope",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or fetch) a session; ``conf`` overrides the defaults above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
