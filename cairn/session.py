"""Session defaults for local runs and tests; on a cluster the submitter's settings stand."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, name: str = "cairn") -> SparkSession:
    n = cores or min(8, os.cpu_count() or 4)
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CAIRN_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )
