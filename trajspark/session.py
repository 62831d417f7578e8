"""Session settings the library is written for; a session made elsewhere works as well."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC everywhere, adaptive plans, and Arrow for the few Python kernels.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build(master: str = "local[*]", app: str = "trajspark", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
