"""Host samples: utilisation figures and recent history per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
HISTORY_SAMPLES = {"web": 900, "tui": 100}
PRIMARY_MOUNTS = {"web": ["/", "/mnt/c"], "tui": ["/", "/mnt/c", "/System/Volumes/Data"]}
# --- end of fixed values ----------------------------------------------------


def mean_core_usage(cores: Column) -> Column:
    total = F.aggregate(cores, F.lit(0.0), lambda acc, usage: acc + usage)
    return F.when(F.size(cores) > 0, total / F.size(cores))


def primary_disk(disks: Column, profile: str = "tui") -> Column:
    """First disk on one of the primary mount points."""
    return F.get(F.filter(disks, lambda disk: disk["mounted_on"].isin(PRIMARY_MOUNTS[profile])), F.lit(0))


def host_metrics(samples: DataFrame, profile: str = "tui") -> DataFrame:
    """``host, ts, cpu_percent, memory_percent, disk_percent`` per sample.

    web takes the reported CPU usage, tui the mean over the cores; without a
    primary disk web shows 0 and tui nothing.
    """
    disk = primary_disk(F.col("disk"), profile)
    used = F.try_divide(disk["used"], disk["size"]) * 100
    return samples.select(
        "host",
        F.col("timestamp").alias("ts"),
        (F.col("cpu.usage") if profile == "web" else mean_core_usage(F.col("cpu.core_usage"))).alias("cpu_percent"),
        (F.try_divide(F.col("memory.used"), F.col("memory.total")) * 100).alias("memory_percent"),
        (F.coalesce(used, F.lit(0.0)) if profile == "web" else used).alias("disk_percent"),
    )


def host_history(metrics: DataFrame, profile: str = "web", samples: int | None = None) -> DataFrame:
    """The newest samples of each host with their rank from the newest.

    Spark keeps the newest rows per host in every task before the shuffle (window
    group limit), so a host with most of the samples sends only its newest ones. Samples
    of one instant are ordered by their figures.
    """
    others = [F.desc(name) for name in metrics.columns if name not in ("host", "ts")]
    newest = Window.partitionBy("host").orderBy(F.desc("ts"), *others)
    ranked = metrics.withColumn("age_rank", F.row_number().over(newest))
    return ranked.where(F.col("age_rank") <= (samples or HISTORY_SAMPLES[profile]))
