"""Session settings for local runs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(name: str = "weftline", cores: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session in UTC with adaptive execution; scratch tables go to WEFT_SHARED_DIR or a folder of this machine."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WEFT_DRIVER_MEMORY", "8g"))
        .config("spark.checkpoint.dir", os.environ.get("WEFT_SHARED_DIR") or "file://" + tempfile.mkdtemp(prefix="weft-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
