"""Session for tests, benchmarks and local work; a cluster brings its own."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "cairn") -> SparkSession:
    cpus = cpus or os.cpu_count() or 4
    scratch = tempfile.mkdtemp(prefix="cairn-")  # one process, one disk: it goes with the process
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("CAIRN_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{scratch}")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
