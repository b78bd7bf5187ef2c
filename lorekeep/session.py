"""Session defaults for local runs; a cluster's own settings win."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "12g",
}


def session(master: str = "local[8]", name: str = "lorekeep") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder, given = SparkSession.builder.appName(name), SparkConf()
    for k, v in ({"spark.master": master} | DEFAULTS).items():
        if not given.contains(k):
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
