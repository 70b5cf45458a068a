"""Session settings the engine expects, and a local session for tests and benchmarks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings every query relies on; sizes are left to the cluster.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | None = None, app: str = "threadlake", **conf: str) -> SparkSession:
    """A single-machine session (tests, benchmark). Clusters bring their own session."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("THREADLAKE_DRIVER_MEMORY", "8g"))
        .config(map=ENGINE_CONF)
        .config(map=conf)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
