"""Streams of log rows: sources, incremental aggregates and sinks.

Aggregates run in update mode with state per key. A batch writes the keys that
changed to its own folder of a change table, and readers keep the newest version of
each key: work per batch follows the new rows, replays overwrite the same folder,
and exact distinct users come from counting keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weblode.functions.status import SUCCESS_RANGE, succeeded
from weblode.operators.error_parse import parse_errors
from weblode.operators.parse import parse_access
from weblode.schemas import HOST_SAMPLE_JSON
from weblode.sources.files import is_error_file, read_log_dir
from weblode.sources.hosts import host_samples
from weblode.sources.sinks import write_log_table
from weblode.sources.tail import tail_logs

# --- fixed values -----------------------------------------------------------
POLL_INTERVAL = "30 seconds"
# --- end of fixed values ----------------------------------------------------

LOCATION_SALTS = 16


def access_stream(spark: SparkSession, path: str, log_format: str | None = None, profile: str = "web") -> DataFrame:
    """Parsed rows of growing access logs."""
    return parse_access(tail_logs(spark, path), log_format, profile)


def error_stream(spark: SparkSession, path: str, profile: str = "web") -> DataFrame:
    return parse_errors(tail_logs(spark, path, "error"), profile)


def rotated_stream(spark: SparkSession, path: str, kind: str = "access", glob: str = "*.{log.[0-9]*,gz}") -> DataFrame:
    """Lines of rotated and compressed files, each file taken once when it appears."""
    reader = spark.readStream.option("lineSep", "\n").option("pathGlobFilter", glob)
    lines = reader.text(path).select("value", F.col("_metadata.file_name").alias("source_file"))
    error = is_error_file(F.col("source_file"))
    return lines.where(F.col("value").rlike(r"\S") & (error if kind == "error" else ~error))


def host_stream(spark: SparkSession, path: str) -> DataFrame:
    """Host samples from JSON files as they appear."""
    return host_samples(spark.readStream.schema(HOST_SAMPLE_JSON).json(path))


def backfill_compressed(spark: SparkSession, path: str, table: str, log_format: str | None = None) -> None:
    """Store the compressed logs of a folder once, before the stream of plain ones starts."""
    packed = read_log_dir(spark, path).where(F.col("source_file").endswith(".gz"))
    write_log_table(parse_access(packed, log_format), table)


def _late(rows: DataFrame, watermark: str | None) -> DataFrame:
    return rows.withWatermark("ts", watermark) if watermark else rows


def key_counts(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Running count per key, for any of the keyed counts."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def user_windows(
    rows: DataFrame,
    step: str,
    watermark: str | None = None,
    success_range: tuple[int, int] = SUCCESS_RANGE["web"],
) -> DataFrame:
    """Figures per time window and user: one aggregation, state per (window, user).

    Without a watermark any lateness counts and state is kept; with one, windows
    that are over leave the state and rows later than that are dropped here, to be
    picked up by the batch operators on the stored table.
    """
    good = succeeded(F.col("status"), success_range)
    return (
        _late(rows.where(F.col("ts").isNotNull()), watermark)
        .groupBy(F.window("ts", step), "ip_address", "user_agent")
        .agg(
            F.count("*").alias("requests"),
            F.count_if(good).alias("success"),
            F.count("status").alias("total"),
        )
        .select(F.col("window.start").alias("bucket"), "ip_address", "user_agent", "requests", "success", "total")
    )


USER_KEYS = ("bucket", "ip_address", "user_agent")


def windows_from_users(users: DataFrame) -> DataFrame:
    """Batch step: the activity series from the newest figures per (window, user)."""
    series = users.groupBy("bucket").agg(
        F.sum("requests").alias("requests"),
        F.count("*").alias("users"),
        F.sum("success").alias("success"),
        F.sum("total").alias("total"),
    )
    return series.withColumn("rate", F.try_divide("success", "total"))


def closed_windows(rows: DataFrame, step: str, watermark: str, approximate: bool = True) -> DataFrame:
    """Activity windows in append mode: each is emitted once, when the watermark passes it.

    Distinct users are a sketch by default; exact ones take a second aggregation
    over (window, user).
    """
    if approximate:
        pair = F.xxhash64("ip_address", "user_agent")
        grouped = _late(rows.where(F.col("ts").isNotNull()), watermark).groupBy(F.window("ts", step))
        windows = grouped.agg(F.count("*").alias("requests"), F.approx_count_distinct(pair).alias("users"))
        return windows.select(F.col("window.start").alias("bucket"), "requests", "users")
    per_user = (
        _late(rows.where(F.col("ts").isNotNull()), watermark)
        .groupBy(F.window("ts", step), "ip_address", "user_agent")
        .agg(F.count("*").alias("n"))
    )
    windows = per_user.groupBy(F.window(F.window_time("window"), step)).agg(
        F.sum("n").alias("requests"), F.count("*").alias("users")
    )
    return windows.select(F.col("window.start").alias("bucket"), "requests", "users")


def located(rows: DataFrame, locations: DataFrame, watermark: str = "1 hour", salts: int = LOCATION_SALTS) -> DataFrame:
    """Recent rows joined to a stream of locations ``ip_address, lat, lon, located_at``.

    A row waits for its location and a location for its rows, both up to the
    watermark; rows without coordinates fall out. Locations are repeated once per
    salt, so that the waiting rows of a hot address are spread over that many tasks.
    """
    placed = locations.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    salted = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    left = _late(rows, watermark).withColumn("salt", salted).alias("r")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    right = placed.withWatermark("located_at", watermark).select("*", every_salt).alias("l")
    near = F.expr(
        f"""r.ip_address = l.ip_address AND r.salt = l.salt
        AND l.located_at BETWEEN r.ts - INTERVAL {watermark} AND r.ts + INTERVAL {watermark}"""
    )
    return left.join(right, near).select("r.ts", "l.lat", "l.lon", "r.status")


def trigger(once: bool, interval: str = POLL_INTERVAL) -> dict:
    return {"availableNow": True} if once else {"processingTime": interval}


def write_changes(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the keys each batch changed to ``path/batch=<version>``.

    A version is the epoch of the checkpoint, then the number of the batch, so those of a
    stream that starts over are newer. ``changes.ChangeTable`` merges its batches; this keeps them.
    """
    from weblode.streaming.changes import change_epoch

    first = change_epoch(stream.sparkSession, f"{path}-of", checkpoint) << 40

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={first + batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(save)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger(once)).start()


def read_changes(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The newest version of every key of a change table."""
    changes = spark.read.parquet(path)
    figures = [name for name in changes.columns if name not in (*keys, "batch")]
    newest = F.max_by(F.struct(*figures), "batch").alias("_newest")
    return changes.groupBy(*keys).agg(newest).select(*keys, *[f"_newest.{name}" for name in figures])


def append_rows(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append parsed rows to the stored log table, by day; filters recompute from there."""
    dated = stream.withColumn("log_date", F.to_date("ts"))
    writer = dated.writeStream.format("parquet").partitionBy("log_date").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger(once)).start()
