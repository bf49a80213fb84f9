"""Hourly figures kept from a stream, and the filters they can answer.

Two change tables: counts by hour, method, path and status, and by hour a sketch of the distinct
users and one of the response sizes. Sketches merge, so users and sizes of any stretch of hours
come from a few hundred rows a month instead of the log. Filters that ask for nothing else than
the keys (or what follows from them: version, hour, weekday) are answered from the counts, all
others from the stored rows, with equal results.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weblode.operators.filters import LogFilter, Settings
from weblode.operators.parse import derive_time
from weblode.streaming.changes import ChangeTable, change_epoch
from weblode.streaming.streams import trigger

CELL_KEYS = ("bucket", "method", "path", "status")
#: Sketch of 2**14 registers: a relative standard error below 1 % for users.
USER_BITS = 14
#: Sketch of sizes: rank error about 0.7 % at 400.
SIZE_ENTRIES = 400


def cells(rows: DataFrame) -> DataFrame:
    """bucket (hour), method, path, status, n."""
    return rows.groupBy(F.date_trunc("hour", "ts").alias("bucket"), "method", "path", "status").agg(F.count("*").alias("n"))


def sketches(rows: DataFrame) -> DataFrame:
    """bucket (hour), requests, first, last, users and sizes as sketches."""
    return rows.groupBy(F.date_trunc("hour", "ts").alias("bucket")).agg(
        F.count("*").alias("requests"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.hll_sketch_agg(F.concat_ws("\x00", "ip_address", "user_agent"), F.lit(USER_BITS)).alias("users"),
        F.kll_sketch_agg_bigint(F.col("response_size").cast("bigint"), F.lit(SIZE_ENTRIES)).alias("sizes"),
    )


def with_keys(counted: DataFrame) -> DataFrame:
    """Cells with ``ts``, ``hour`` and ``day_of_week``, as filters on log rows expect them."""
    return derive_time(counted.withColumn("ts", F.col("bucket")))


def answers(wanted: LogFilter, settings: Settings = Settings()) -> bool:
    """Whether the hourly cells decide the filter: no other columns, and a period that starts on the hour."""
    other = (wanted.location, wanted.referrer, wanted.client, wanted.os, wanted.device_type)
    if any(value is not None for value in other) or settings.exclude_bots:
        return False
    if not wanted.period.bounded:
        return True
    at = wanted.period.as_of
    # The rows of the starting hour count all or none only if the start itself counts.
    return wanted.period.profile == "web" and at == at.replace(minute=0, second=0, microsecond=0)


class HourRollup:
    def __init__(self, spark: SparkSession, path: str, compact_every: int = 20):
        self.spark, self.path = spark, path
        self.counts = ChangeTable(spark, f"{path}/counts", CELL_KEYS, {"n": "sum"}, compact_every)
        figures = {"requests": "sum", "first": "min", "last": "max", "users": "hll", "sizes": "kll"}
        self.hours = ChangeTable(spark, f"{path}/hours", ("bucket",), figures, compact_every)

    def write(self, rows: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Keep the figures of a stream of parsed rows; each batch is read twice and not kept."""
        epochs = [change_epoch(self.spark, table.path, checkpoint) for table in (self.counts, self.hours)]

        def save(batch: DataFrame, batch_id: int) -> None:
            self.counts.save(cells(batch), epochs[0], batch_id)
            self.hours.save(sketches(batch), epochs[1], batch_id)

        writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        return writer.trigger(**trigger(once)).start()

    def cells(self, wanted: LogFilter = LogFilter(), settings: Settings = Settings(), stored: DataFrame | None = None) -> DataFrame:
        """bucket, method, path, status, n of the rows that pass a filter: from the kept counts if they decide it, else from ``stored`` rows."""
        if answers(wanted, settings):
            return with_keys(self.counts.read()).where(wanted.to_column(settings)).select(*CELL_KEYS, "n")
        if stored is None:
            raise ValueError("this filter needs the stored rows")
        return cells(wanted.apply(stored, settings))

    def _between(self, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
        """The hours from ``start`` up to ``end``, both on the hour."""
        wanted = F.lit(True)
        for bound, keep in ((start, F.col("bucket").__ge__), (end, F.col("bucket").__lt__)):
            if bound is not None:
                wanted = wanted & keep(F.lit(bound).cast("timestamp"))
        return self.hours.read(wanted)

    def users(self, start: dt.datetime | None = None, end: dt.datetime | None = None, step: str | None = None) -> DataFrame:
        """Estimated distinct users (and exact requests) of a stretch of hours, by ``step`` (``day``, ``month``) if one is given."""
        keys = [F.date_trunc(step, "bucket").alias("bucket")] if step else []
        found = self._between(start, end).groupBy(*keys).agg(F.sum("requests").alias("requests"), F.hll_union_agg("users", F.lit(True)).alias("sketch"))
        return found.select(*(["bucket"] if step else []), "requests", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("users"))

    def size_quantiles(self, shares: Sequence[float], start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
        """share, size: estimated quantiles of the response sizes."""
        merged = self._between(start, end).agg(F.kll_merge_agg_bigint("sizes").alias("sketch"))
        found = [
            F.struct(F.lit(float(share)).alias("share"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(share))).alias("size")) for share in shares
        ]
        return merged.where("sketch IS NOT NULL").select(F.inline(F.array(*found)))
