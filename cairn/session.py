"""The SparkSession that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans coalesce and split shuffle partitions by size, so one setting serves small and large inputs.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "cairn", **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf keys use _ for dots, as in spark_sql_shuffle_partitions="64"."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    own = {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=DEFAULTS | own).getOrCreate()
