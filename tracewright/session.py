"""Session construction and the settings every plan in this package relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings a caller's own session should carry as well.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "tracewright", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time zone and adaptive execution; ``master`` only where none is given from outside."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**REQUIRED, "spark.ui.enabled": "false", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def local_session(cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench on one machine."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return build_session(
        "tracewright-local",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": memory,
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.ui.showConsoleProgress": "false",
        },
    )
