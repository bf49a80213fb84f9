"""Streaming queries run to completion on the given tables, for comparison with batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from weblode.operators.parse import parse_access
from weblode.plans.staging import stage
from weblode.session import shared_dir
from weblode.sources.tail import tail_logs
from weblode.streaming import streams
from weblode.streaming.changes import ChangeTable
from weblode.streaming.late import LateWindows
from weblode.streaming.pending import located_later
from weblode.streaming.rollup import HourRollup


def work_dir(spark: SparkSession) -> str:
    """A new folder on the cluster's shared storage."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream and turned into access rows."""
    schema = fx.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = spark.sql(
        fx.over_frames(fx.ACCESS_ROWS),
        events=events,
        pages=fx.table(spark, sf_dir, "pages"),
    )
    return rows.where("NOT is_malformed")


def replay_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly activity from the change table of a stream."""
    folder = work_dir(spark)
    table = ChangeTable(spark, f"{folder}/users", streams.USER_KEYS, {"requests": "sum", "success": "sum", "total": "sum"})
    add = lambda batch: streams.user_windows(batch, "1 hour")
    table.write(event_stream(spark, sf_dir), f"{folder}/checkpoint", once=True, aggregate=add).awaitTermination()
    return streams.windows_from_users(table.read())


def replay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running endpoint counts of a stream with state, whose newest values are kept."""
    folder = work_dir(spark)
    table = ChangeTable(spark, f"{folder}/counts", ("path", "method", "status"), {"n": "newest"})
    counted = streams.key_counts(event_stream(spark, sf_dir), "path", "method", "status")
    table.write(counted, f"{folder}/checkpoint", once=True).awaitTermination()
    return table.read()


def replay_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per day of the table a stream appends to."""
    folder = work_dir(spark)
    rows = event_stream(spark, sf_dir)
    streams.append_rows(rows, f"{folder}/log", f"{folder}/checkpoint", once=True).awaitTermination()
    by_day = spark.read.parquet(f"{folder}/log").groupBy("log_date").agg(F.count("*").alias("n"))
    return by_day.select(F.col("log_date").cast("string").alias("log_date"), "n")


def replay_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily activity of the log lines, written to files and followed by the tail source."""
    folder = work_dir(spark)
    fx.access_lines(spark, sf_dir).select("value").write.text(f"{folder}/logs")
    lines = tail_logs(spark, f"{folder}/logs", split_bytes=1 << 20, names=r"\.txt$")
    users = streams.user_windows(parse_access(lines), "1 day")
    streams.write_changes(users, f"{folder}/users", f"{folder}/checkpoint", once=True).awaitTermination()
    return streams.windows_from_users(streams.read_changes(spark, f"{folder}/users", *streams.USER_KEYS))


def replay_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows in append mode with exact users: those the watermark has passed."""
    folder = work_dir(spark)
    windows = streams.closed_windows(event_stream(spark, sf_dir), "1 hour", "10 minutes", approximate=False)
    writer = windows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/windows")
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/windows")


def replay_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests joined to the location of their address, known from its first request on."""
    folder = work_dir(spark)
    octet = F.split("ip_address", r"\.")
    places = fx.access_log(spark, sf_dir).groupBy("ip_address").agg(F.min("ts").alias("located_at"))
    places = places.withColumns({"lat": F.get(octet, F.lit(2)).cast("double"), "lon": F.get(octet, F.lit(3)).cast("double")})
    places.write.parquet(f"{folder}/places")
    located_places = spark.readStream.schema(places.schema).parquet(f"{folder}/places")
    rows = event_stream(spark, sf_dir).select("ts", "ip_address", "user_agent", "event_id", "status")
    points = streams.located(rows, located_places, "1 hour")
    writer = points.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/points")
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/points")


def replay_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts by level of error lines that the tail source follows."""
    folder = work_dir(spark)
    levels = streams.key_counts(streams.error_stream(spark, fx.write_log_folder(spark, sf_dir)), "level")
    streams.write_changes(levels, f"{folder}/levels", f"{folder}/checkpoint", once=True).awaitTermination()
    return streams.read_changes(spark, f"{folder}/levels", "level")


def replay_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of rotated and compressed access logs, by kind of file."""
    folder = work_dir(spark)
    lines = streams.rotated_stream(spark, fx.write_log_folder(spark, sf_dir))
    kinds = streams.key_counts(lines, F.regexp_replace("source_file", "-[0-9]+", "").alias("kind"))
    streams.write_changes(kinds, f"{folder}/kinds", f"{folder}/checkpoint", once=True).awaitTermination()
    return streams.read_changes(spark, f"{folder}/kinds", "kind")


def replay_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by host from JSON files that appear in a folder."""
    folder = work_dir(spark)
    fx.host_samples(spark, sf_dir).write.json(f"{folder}/samples")
    hosts = streams.key_counts(streams.host_stream(spark, f"{folder}/samples"), "host")
    streams.write_changes(hosts, f"{folder}/hosts", f"{folder}/checkpoint", once=True).awaitTermination()
    return streams.read_changes(spark, f"{folder}/hosts", "host")


def event_files(spark: SparkSession, sf_dir: str, folder: str, late_from: int) -> str:
    """The events as two batches of files: those with a number below ``late_from`` of 10, then the others, far too late."""
    events = fx.table(spark, sf_dir, "events")
    events.where(f"event_id % 10 < {late_from}").write.parquet(f"{folder}/events")
    return f"{folder}/events"


def events_from(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    events = spark.readStream.schema(fx.table(spark, sf_dir, "events").schema).parquet(folder)
    rows = spark.sql(fx.over_frames(fx.ACCESS_ROWS), events=events, pages=fx.table(spark, sf_dir, "pages"))
    return rows.where("NOT is_malformed")


def replay_late(spark: SparkSession, sf_dir: str) -> LateWindows:
    """Hourly windows that close, and are mended when three tenths of the rows come after all others."""
    folder = work_dir(spark)
    source = event_files(spark, sf_dir, folder, 7)
    windows = LateWindows(spark, f"{folder}/table", "1 hour", "10 minutes", compact_every=2)
    for batch in ("7", "8", "9"):
        windows.write(events_from(spark, sf_dir, source), f"{folder}/checkpoint", once=True).awaitTermination()
        fx.table(spark, sf_dir, "events").where(f"event_id % 10 = {batch}").write.mode("append").parquet(source)
    windows.write(events_from(spark, sf_dir, source), f"{folder}/checkpoint", once=True).awaitTermination()
    return windows


def replay_rollup(spark: SparkSession, sf_dir: str) -> HourRollup:
    """Hourly figures of a stream in three batches, merged into a base on the way."""
    folder = work_dir(spark)
    source = event_files(spark, sf_dir, folder, 4)
    rollup = HourRollup(spark, f"{folder}/table", compact_every=2)
    for first, end in ((4, 7), (7, 10)):
        rollup.write(events_from(spark, sf_dir, source), f"{folder}/checkpoint", once=True).awaitTermination()
        fx.table(spark, sf_dir, "events").where(f"event_id % 10 >= {first} AND event_id % 10 < {end}").write.mode("append").parquet(source)
    rollup.write(events_from(spark, sf_dir, source), f"{folder}/checkpoint", once=True).awaitTermination()
    return rollup


def replay_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint counts of a stream that starts over with a new checkpoint, before and after its changes are merged."""
    folder = work_dir(spark)
    keys = ("path", "method", "status")
    table = ChangeTable(spark, f"{folder}/counts", keys, {"n": "sum"}, compact_every=2)
    source = event_files(spark, sf_dir, folder, 6)
    rows = events_from(spark, sf_dir, source)
    add = lambda batch: streams.key_counts(batch, *keys)
    table.write(rows, f"{folder}/first", once=True, aggregate=add).awaitTermination()
    fx.table(spark, sf_dir, "events").where("event_id % 10 >= 6").write.mode("append").parquet(source)
    table.write(rows, f"{folder}/first", once=True, aggregate=add).awaitTermination()
    table.write(rows, f"{folder}/second", once=True, aggregate=add).awaitTermination()
    table.compact()
    return table.read()


def replay_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests placed by a stateful operator: half of the locations come after the requests."""
    folder = work_dir(spark)
    octet = F.split("ip_address", r"\.")
    places = fx.access_log(spark, sf_dir).select("ip_address").distinct().withColumn("located_at", F.lit(fx.AS_OF).cast("timestamp"))
    places = places.withColumns({"lat": F.get(octet, F.lit(2)).cast("double"), "lon": F.get(octet, F.lit(3)).cast("double")})
    early = F.col("lat").cast("int") % 2 == 0
    places.where(early).write.parquet(f"{folder}/places")

    def run() -> None:
        known = spark.readStream.schema(places.schema).parquet(f"{folder}/places")
        points = located_later(event_stream(spark, sf_dir).select("ts", "ip_address", "status"), known)
        writer = points.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/points")
        writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    run()
    places.where(~early & (F.col("lat") < 29)).write.mode("append").parquet(f"{folder}/places")
    run()
    return spark.read.parquet(f"{folder}/points")


def replay_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed logs go to the table first and once, then the stream of plain ones is appended."""
    folder, logs = work_dir(spark), fx.write_log_folder(spark, sf_dir)
    streams.backfill_compressed(spark, logs, f"{folder}/log")
    for _ in range(2):  # the second run finds nothing new
        streams.append_rows(streams.access_stream(spark, logs), f"{folder}/plain", f"{folder}/checkpoint", once=True).awaitTermination()
    both = [spark.read.parquet(f"{folder}/{name}").select(F.col("log_date").cast("string").alias("log_date")) for name in ("log", "plain")]
    return both[0].unionByName(both[1]).groupBy("log_date").agg(F.count("*").alias("n"))


LOG_PARTS = 3


def put_log_files(lines: DataFrame, upto: int, folder: str, name: str) -> None:
    """Files of the lines of steps up to ``upto`` and half of the next line, in place of files of that name."""
    shown = lines.where(F.col("step") <= upto).select("part", "step", "event_id", F.concat("value", F.lit("\n")).alias("value"))
    cut = lines.where(F.col("step") > upto).groupBy("part").agg(F.min(F.struct("step", "event_id", "value")).alias("next"))
    cut = cut.select("part", "next.step", "next.event_id", F.expr("left(next.value, 20)").alias("value"))
    fx.write_in_order(shown.unionByName(cut), ("step", "event_id"), folder, {part: f"logs/{name.format(part)}" for part in range(LOG_PARTS)}, "\x00")


def replay_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by day and status from log files that grow, end inside a line, are rotated and replaced, read in bounded batches."""
    folder = work_dir(spark)
    lines = fx.access_lines(spark, sf_dir).withColumns({"step": F.expr("event_id % 5"), "part": F.expr(f"event_id DIV 5 % {LOG_PARTS}")})
    lines = stage(lines, "lines")
    table = ChangeTable(spark, f"{folder}/days", ("log_date", "status"), {"n": "sum"}, compact_every=4)
    # The source bounds a batch to 400 kB, which one task counts without a shuffle.
    day, n = F.to_date("ts").cast("string").alias("log_date"), F.count("*").alias("n")
    add = lambda batch: batch.coalesce(1).groupBy(day, "status").agg(n)
    # A batch is computed with all its columns, so those that are not counted are left out before.
    rows = parse_access(tail_logs(spark, f"{folder}/logs", max_bytes=400_000, positions=f"{folder}/positions")).select("ts", "status")

    def follow() -> None:
        query = table.write(rows, f"{folder}/checkpoint", aggregate=add, interval="0 seconds")
        query.processAllAvailable()
        query.stop()

    put_log_files(lines, 0, folder, "access-{}.log")
    follow()
    put_log_files(lines, 1, folder, "access-{}.log")  # grown, and the cut line is whole now
    follow()
    put_log_files(lines.where("step <= 2"), 2, folder, "access-{}.log.1")  # rotated with what came last
    put_log_files(lines.where("step = 3"), 3, folder, "access-{}.log")
    follow()
    put_log_files(lines.where("step = 4"), 4, folder, "access-{}.log")  # replaced by a new file
    follow()
    return table.read()
