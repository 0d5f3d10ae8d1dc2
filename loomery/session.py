"""The session that entry points use when none is given."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session() -> SparkSession:
    """The active session, or a local one."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("LOOMERY_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("loomery").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", os.environ.get("LOOMERY_MEMORY", "8g")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
