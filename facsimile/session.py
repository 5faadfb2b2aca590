"""Session defaults for local work; a cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", name: str = "facsimile", **conf: str) -> SparkSession:
    partitions = os.cpu_count() if cores == "*" else int(cores)
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.driver.memory", "12g")
               .config("spark.driver.host", "127.0.0.1"))
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
