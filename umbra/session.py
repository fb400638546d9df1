"""Session defaults used by tests, benchmarks and scripts."""

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, name: str = "umbra") -> SparkSession:
    """A ``local[cpus]`` session with UTC time, AQE and one shuffle partition per core."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
