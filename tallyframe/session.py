"""Session helpers.

Library operators never build or configure a session: the caller owns it.
``local_session`` exists for tests, ``bench.py`` and the entry module.  It
keeps ANSI mode on (every cast in the library is explicit), pins the session
time zone, turns on adaptive execution and keeps the web UI off.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings that matter at cluster scale and that the library's plans assume.
SCALE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int = 8,
    app_name: str = "tallyframe",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TALLYFRAME_DRIVER_MEMORY", "8g"))
    )
    for key, value in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
