"""Session settings the plans are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def workers_find_package(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package where it is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def tune(spark: SparkSession) -> SparkSession:
    """Settings for the wide feature stages.

    Code generation stays on for them, but not for methods that the virtual
    machine would refuse to compile because of their size (8000 bytes).
    """
    spark.conf.set("spark.sql.codegen.maxFields", "400")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def local_session(cpus: str | None = None, app: str = "barflow") -> SparkSession:
    """Session for tests and benchmarks on one machine.

    Without the data-frame debugging setting PySpark looks up the call site of
    every column operation, which dominates the building of wide plans.
    """
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
