"""Host samples from JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.schemas import HOST_SAMPLE_JSON


def host_samples(records: DataFrame) -> DataFrame:
    """Records with the JSON field names to the names used here; also for streams."""
    return records.select(
        F.coalesce("host", F.lit("")).alias("host"),
        "uptime",
        "timestamp",
        F.struct(
            "cpu.model", "cpu.cores", "cpu.speed", "cpu.usage", F.col("cpu.coreUsage").alias("core_usage")
        ).alias("cpu"),
        "memory",
        F.transform(
            "disk",
            lambda d: F.struct(
                d["filesystem"].alias("filesystem"),
                d["size"].alias("size"),
                d["used"].alias("used"),
                d["mountedOn"].alias("mounted_on"),
            ),
        ).alias("disk"),
    )


def read_host_samples(spark: SparkSession, path: str) -> DataFrame:
    return host_samples(spark.read.schema(HOST_SAMPLE_JSON).json(path))
