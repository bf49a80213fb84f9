"""CSV export and the stored log table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.functions.text import csv_safe

# --- fixed values -----------------------------------------------------------
# CSV column -> log column, in output order.
CSV_COLUMNS = {
    "timestamp": "ts",
    "path": "path",
    "method": "method",
    "status": "status",
    "ipAddress": "ip_address",
    "userAgent": "user_agent",
    "responseSize": "response_size",
    "httpVersion": "http_version",
    "referrer": "referrer",
}
CSV_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# --- end of fixed values ----------------------------------------------------


def csv_rows(df: DataFrame) -> DataFrame:
    """The export columns as text: UTC time, nulls empty, formula guard."""
    utc = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), CSV_TIME_FORMAT)
    texts = {**{name: F.col(source).cast("string") for name, source in CSV_COLUMNS.items()}, "timestamp": utc}
    return df.select(*[csv_safe(F.coalesce(text, F.lit(""))).alias(name) for name, text in texts.items()])


def write_csv(df: DataFrame, path: str) -> None:
    """Write one CSV part per task, each with the header row."""
    (
        csv_rows(df)
        .write.option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .mode("overwrite")
        .csv(path)
    )


def write_log_table(df: DataFrame, path: str, mode: str = "append", rebalance: bool = False) -> None:
    """Store parsed rows as Parquet by day, sorted by time within each file.

    Log files are nearly in time order, so each task holds few days and writes
    them without a shuffle; the sort keeps one open writer per task and gives tight
    time ranges for row-group skipping. ``rebalance`` adds one shuffle that merges
    small outputs and splits a day that is larger than the rest. Rows without a
    time share one partition.
    """
    dated = df.withColumn("log_date", F.to_date("ts"))
    if rebalance:
        dated = dated.hint("rebalance", "log_date")
    dated.sortWithinPartitions("log_date", "ts").write.mode(mode).partitionBy("log_date").parquet(path)


def read_log_table(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Stored rows; with bounds only the days in question are read."""
    table = spark.read.parquet(path)
    for bound, keep in ((start, F.col("log_date").__ge__), (end, F.col("log_date").__le__)):
        if bound is not None:
            table = table.where(keep(F.to_date(F.lit(bound).cast("timestamp"))))
    return table
