"""Requests that wait for the location of their address, as a stateful operator.

The state of an address is its location and, while that is unknown, the requests that wait for
it. A location empties the buffer at once and later requests pass through without being kept, so
the state is one value for each known address and the requests of unknown ones. Requests of a
hot address are dealt to ``salts`` keys, each with a copy of the location.

A timer of the address drops requests that have waited longer than ``patience``. Time is that of
arrival: the watermark follows the instant a row came in, so no row is ever too late, whatever
its own time, and a timer is due with the first batch after its instant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weblode.streaming.late import micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POINTS = "ts timestamp, lat double, lon double, status int"
SALTS = 4


class WaitingRequests(StatefulProcessor):
    """Rows: at (microseconds), status, lat, lon, located, came (milliseconds); ``located`` tells the two streams apart."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "at bigint, lat double, lon double")
        self.waiting = handle.getListState("waiting", "at bigint, status int, since bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        place = self.place.get() if self.place.exists() else None
        came, now = [], 0
        for frame in rows:
            now = max(now, int(frame["came"].max()))
            located = frame["located"].to_numpy(bool)
            for at, lat, lon in frame.loc[located, ["at", "lat", "lon"]].itertuples(index=False):
                if place is None or at >= place[0]:
                    place = (int(at), float(lat), float(lon))
                    self.place.update(place)
            requests = frame.loc[~located, ["at", "status"]]
            came += [(int(at), None if pd.isna(status) else int(status)) for at, status in requests.itertuples(index=False)]
        if place is not None:
            if self.waiting.exists():
                came += [(row[0], row[1]) for row in self.waiting.get()]
                self.waiting.clear()
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            if came:
                yield self._points(place, came)
        elif came:
            self.waiting.appendList([(at, status, now) for at, status in came])
            self.handle.registerTimer(now + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        oldest = expiredTimerInfo.getExpiryTimeInMs() - self.patience_ms
        kept = [(row[0], row[1], row[2]) for row in self.waiting.get() if row[2] > oldest] if self.waiting.exists() else []
        self.waiting.clear()
        if kept:
            self.waiting.put(kept)
        return iter([])

    def _points(self, place: tuple, came: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({
            "ts": pd.to_datetime([at for at, _ in came], unit="us"), "lat": place[1], "lon": place[2],
            "status": pd.array([status for _, status in came], dtype="Int32"),
        })

    def close(self) -> None:
        """Nothing to release."""


def located_later(rows: DataFrame, locations: DataFrame, patience: str = "1 hour", salts: int = SALTS) -> DataFrame:
    """``ts, lat, lon, status`` of requests (``ts, ip_address, status``) whose address gets a location, before or after them.

    ``locations`` is a stream ``ip_address, lat, lon, located_at``; of several the latest counts
    for requests that are still to be placed. The streams must not have watermarks of their own.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    told_apart = [name for name, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    salt = F.pmod(F.xxhash64(*told_apart), F.lit(salts)).cast("int")
    none = F.lit(None).cast("double")
    requests = rows.where(F.col("ts").isNotNull()).select(
        "ip_address", salt.alias("salt"), F.unix_micros("ts").alias("at"), F.col("status").cast("int").alias("status"), none.alias("lat"), none.alias("lon"),
        F.lit(False).alias("located"),
    )
    known = locations.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "ip_address", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.unix_micros("located_at").alias("at"), F.lit(None).cast("int").alias("status"),
        F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.lit(True).alias("located"),
    )
    both = requests.unionByName(known).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    both = both.withColumn("came", F.unix_millis("arrived")).groupBy("ip_address", "salt")
    return both.transformWithStateInPandas(WaitingRequests(micros(patience) // 1000), POINTS, "Append", "EventTime")
