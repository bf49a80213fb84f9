"""Sizes of log files: the summary and the list by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
LOG_EXTENSION = ".log"
ROTATED_PATTERN = r"\.log\.\d+$"
COMPRESSED_EXTENSIONS = [".gz", ".zip", ".tar"]
# --- end of fixed values ----------------------------------------------------


def file_summary(catalog: DataFrame) -> DataFrame:
    """One row: size and number of all files, of logs (rotated ones too) and of compressed files."""
    is_log = (F.col("extension") == LOG_EXTENSION) | F.col("name").rlike(ROTATED_PATTERN)
    is_packed = ~is_log & F.col("extension").isin(COMPRESSED_EXTENSIONS)

    def size_of(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0).cast("bigint"))

    return catalog.agg(
        size_of(F.lit(True)).alias("total_size"),
        size_of(is_log).alias("log_files_size"),
        size_of(is_packed).alias("compressed_files_size"),
        F.count("*").alias("total_files"),
        F.count_if(is_log).alias("log_files_count"),
        F.count_if(is_packed).alias("compressed_files_count"),
    )


def largest_files(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("size"), "name")
