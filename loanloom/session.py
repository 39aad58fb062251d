"""Session settings that the wide feature tables rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Feature rows have several hundred columns; the default limit of 100 would turn
# code generation off for the wide joins and projections.
WIDE_ROWS = {"spark.sql.codegen.maxFields": "1000"}
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; the cluster's own sizing stays as it is."""
    for key, value in {**WIDE_ROWS, **ADAPTIVE}.items():
        spark.conf.set(key, value)
    return spark


def local_session(threads: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return configure(
        SparkSession.builder.master(f"local[{threads}]")
        .appName("loanloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
