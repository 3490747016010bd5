"""Session defaults; every setting can be overridden by the cluster's own configuration."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Set only where the caller or the cluster has not decided already.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "granary", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """A supplied table; Catalyst prunes columns and pushes filters into the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
