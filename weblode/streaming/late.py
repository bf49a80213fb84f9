"""Activity windows that close behind a watermark and are mended when late rows arrive.

No row is dropped. Each batch adds its figures per (window, user) to a change table. Windows
that the watermark passes are written out as closed; rows that come for a closed window go to
a side output, and the windows they touch are worked out again and written with a newer
version. Readers of the windows take the newest version of each.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weblode.functions.status import SUCCESS_RANGE
from weblode.sources.shared import SharedFolder
from weblode.streaming.changes import ChangeTable, change_epoch
from weblode.streaming.streams import USER_KEYS, trigger, user_windows, windows_from_users

NONE = -(1 << 62)
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def micros(interval: str) -> int:
    """Length of a text like ``10 minutes``."""
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", interval)
    if not found:
        raise ValueError(f"not a length of time: {interval}")
    return int(found[1]) * _UNITS[found[2]] * 1_000_000


class LateWindows:
    """Windows of length ``step`` that close when rows ``delay`` past their end have come."""

    def __init__(self, spark: SparkSession, path: str, step: str, delay: str, success_range: tuple[int, int] = SUCCESS_RANGE["web"], compact_every: int = 20):
        self.spark, self.path, self.step, self.success_range = spark, path, step, success_range
        self.length, self.delay = micros(step), micros(delay)
        self.marks = SharedFolder(spark, f"{path}/marks")
        sums = {"requests": "sum", "success": "sum", "total": "sum"}
        self.users = ChangeTable(spark, f"{path}/users", USER_KEYS, sums, compact_every)
        figures = {name: "newest" for name in ("requests", "users", "success", "total", "rate")}
        self.windows = ChangeTable(spark, f"{path}/windows", ("bucket",), figures, compact_every)

    def _mark(self, epoch: int, batch_id: int, batch: DataFrame) -> tuple[int, int]:
        """Watermark before and after a batch, in microseconds; kept, so that a batch that runs again gets the same."""
        name = f"{epoch:06d}-{batch_id:012d}"
        if not self.marks.exists(name):
            earlier = [n for n in self.marks.names() if n[:6] == name[:6] and n < name]
            before = int(self.marks.read(earlier[-1]).split()[1]) if earlier else NONE
            latest = batch.agg(F.unix_micros(F.max("ts")).alias("latest")).first()["latest"]
            after = before if latest is None else max(before, latest - self.delay)
            self.marks.write_new(name, f"{before} {after}")
            for old in earlier[:-1]:
                self.marks.delete(old)
        before, after = map(int, self.marks.read(name).split())
        return before, after

    def _save(self, batch: DataFrame, epoch: int, batch_id: int) -> None:
        batch = batch.where(F.col("ts").isNotNull()).persist()
        try:
            before, after = self._mark(epoch, batch_id, batch)
            self.users.save(user_windows(batch, self.step, success_range=self.success_range), epoch, batch_id)
            bucket = F.window("ts", self.step)["start"]
            late = batch.withColumn("bucket", bucket).where(F.unix_micros("bucket") + self.length <= before)
            late.write.mode("overwrite").parquet(f"{self.path}/late/batch={epoch:06d}-{batch_id:012d}")
            touched = late.select("bucket").distinct()
            end = F.unix_micros("bucket") + self.length
            closing = self.users.read((end > before) & (end <= after))
            mended = self.users.read_some(touched)
            self.windows.save(windows_from_users(closing.unionByName(mended)), epoch, batch_id)
        finally:
            batch.unpersist()

    def write(self, rows: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Start the stream over parsed rows (``ts, ip_address, user_agent, status`` and others)."""
        epoch = change_epoch(self.spark, self.path, checkpoint)
        writer = rows.writeStream.foreachBatch(lambda batch, batch_id: self._save(batch, epoch, batch_id))
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger(once)).start()

    def closed(self) -> DataFrame:
        """bucket, requests, users, success, total, rate of the closed windows, late rows included."""
        return self.windows.read()

    def current(self) -> DataFrame:
        """All windows as of now, the open ones too."""
        return windows_from_users(self.users.read())

    def late_rows(self) -> DataFrame:
        """The rows that came for closed windows, with their ``bucket`` and ``batch``."""
        return self.spark.read.parquet(f"{self.path}/late")

    def watermark(self) -> dt.datetime | None:
        names = self.marks.names()
        at = int(self.marks.read(names[-1]).split()[1]) if names else NONE
        return None if at == NONE else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=at)
