"""Figures by key that a stream adds to, stored as a merged base and the changes since.

A batch writes what it adds (a few figures for each key it touches) to a folder of its own,
so a stream that only sums needs no state and takes rows of any lateness. Figures are merged
by key when they are read: sums, smallest and largest values, sketches, or the newest value.

After every ``compact_every`` batches base and changes are merged into a new base. A manifest
names the base and the batches it holds; it is written last and whole, readers start from the
newest one, and what it replaces is deleted one compaction later, so that a reader keeps its
files. A batch that Spark runs again is known by its number: it is left alone if its folder is
complete or merged.

What a batch costs does not grow with the batches before it: manifests are numbered one by one
and never change, so a writer looks for the next number only, and a small base is merged by one
task without a shuffle.

Batches are numbered by (epoch, batch). A checkpoint is given its epoch when it first writes to
the table, so a stream that starts over with a new checkpoint, whose batch numbers begin at 0
again, counts as newer. By default it replaces what earlier epochs wrote, since it reads its
source from the start; with ``restart="add"`` (a source that goes on where it was) it adds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weblode.sources.shared import SharedFolder
from weblode.streaming.streams import POLL_INTERVAL, trigger

COMPACT_EVERY = 20
#: Stored bytes of base and changes that one task merges without a shuffle.
SMALL_BYTES = 4 * 1024 * 1024
NEWEST = "newest"
MERGES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "hll": lambda sketch: F.hll_union_agg(sketch, F.lit(True)),
    "kll": F.kll_merge_agg_bigint,
}
_VERSION = "change_version"


def _manifest_name(number: int) -> str:
    return f"manifests/{number:09d}"


def change_epoch(spark: SparkSession, table: str, checkpoint: str) -> int:
    """The number under which a checkpoint writes to a table: its own, or the next free one."""
    own, all_ = SharedFolder(spark, checkpoint), SharedFolder(spark, f"{table}/epochs")
    if not own.exists("change-table-id"):
        own.write_new("change-table-id", uuid.uuid4().hex)
    name = own.read("change-table-id")
    while True:
        taken = all_.names()
        for number in taken:
            if all_.read(number) == name:
                return int(number)
        # Two new checkpoints may want the same number; one of them gets it.
        all_.write_new(f"{len(taken):06d}", name)


@dataclass
class ChangeTable:
    """``figures`` maps each column to how it is merged: a name of ``MERGES`` or ``newest``."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    figures: dict[str, str]
    compact_every: int = COMPACT_EVERY
    restart: str = "replace"

    def __post_init__(self) -> None:
        self.folder = SharedFolder(self.spark, self.path)
        self._manifest: dict | None = None

    # --- what is there -------------------------------------------------------

    def manifest(self) -> dict:
        """The newest manifest; those after the last one seen are looked for by number, since any writer may add them."""
        seen = self._manifest
        if seen is None or not self.folder.exists(_manifest_name(seen["number"])):
            names = self.folder.names("manifests")
            if not names:
                return {"number": 0, "base": None, "epoch": -1, "merged": {}, "replaced": []}
            seen = json.loads(self.folder.read(f"manifests/{names[-1]}"))
        while self.folder.exists(_manifest_name(seen["number"] + 1)):
            seen = json.loads(self.folder.read(_manifest_name(seen["number"] + 1)))
        self._manifest = seen
        return seen

    def _changes(self, manifest: dict) -> list[tuple[int, int, str]]:
        """(epoch, batch, name) of complete changes that are not in the base."""
        found = []
        for name in self.folder.names("changes"):
            epoch, batch = map(int, name.split("-"))
            if batch > manifest["merged"].get(str(epoch), -1) and self.folder.exists(f"changes/{name}/_SUCCESS"):
                found.append((epoch, batch, f"changes/{name}"))
        return found

    def _live(self) -> tuple[dict, list[tuple[int, int, str]], list[str]]:
        """(manifest, changes, names of all folders that count)."""
        manifest = self.manifest()
        changes = self._changes(manifest)
        base = [manifest["base"]] if manifest["base"] else []
        if self.restart == "replace" and changes:
            newest = max([manifest["epoch"], *[epoch for epoch, _, _ in changes]])
            changes = [change for change in changes if change[0] == newest]
            base = base if manifest["epoch"] == newest else []
        return manifest, changes, [*base, *[name for _, _, name in changes]]

    def _schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.folder.read("schema.json")))

    # --- reading -------------------------------------------------------------

    def merged(self, rows: DataFrame) -> DataFrame:
        """One row a key."""
        newest = [name for name, how in self.figures.items() if how == NEWEST]
        found = [MERGES[how](F.col(name)).alias(name) for name, how in self.figures.items() if how != NEWEST]
        if newest:
            found.append(F.max_by(F.struct(*newest), _VERSION).alias("_newest"))
            found.append(F.max(_VERSION).alias(_VERSION))
        one = rows.groupBy(*self.keys).agg(*found)
        values = [F.col(f"_newest.{name}" if how == NEWEST else name).alias(name) for name, how in self.figures.items()]
        return one.select(*self.keys, *values, *([_VERSION] if newest else []))

    def _stored(self, names: list[str]) -> DataFrame:
        schema = self._schema()
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}" for name in names])

    def read(self, wanted: Column | None = None) -> DataFrame:
        """The figures of every key; ``wanted`` narrows the keys before anything is merged."""
        rows = self._stored(self._live()[2])
        return self.merged(rows if wanted is None else rows.where(wanted)).select(*self.keys, *self.figures)

    def read_some(self, keys: DataFrame) -> DataFrame:
        """The figures of the keys that match ``keys``, a frame of some of the key columns."""
        rows = self._stored(self._live()[2])
        return self.merged(rows.join(keys.distinct(), keys.columns, "left_semi")).select(*self.keys, *self.figures)

    # --- writing -------------------------------------------------------------

    def save(self, changes: DataFrame, epoch: int, batch_id: int) -> bool:
        """Store what a batch adds; false if it was stored before."""
        name = f"changes/{epoch:06d}-{batch_id:012d}"
        if batch_id <= self.manifest()["merged"].get(str(epoch), -1) or self.folder.exists(f"{name}/_SUCCESS"):
            return False
        rows = changes.select(*self.keys, *self.figures)
        if NEWEST in self.figures.values():
            rows = rows.withColumn(_VERSION, F.lit((epoch << 40) + batch_id).cast("bigint"))
        if not self.folder.exists("schema.json"):
            self.folder.write_new("schema.json", rows.schema.json())
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        if len(self._live()[1]) >= self.compact_every:
            self.compact()
        return True

    def compact(self) -> None:
        """Merge base and changes into a new base; delete what the compaction before replaced."""
        manifest, changes, live = self._live()
        if not changes:
            return
        number = manifest["number"] + 1
        base = f"bases/{number:06d}-{uuid.uuid4().hex}"
        rows = self._stored(live)
        if sum(self.folder.size(name) for name in live) <= SMALL_BYTES:
            rows = rows.coalesce(1)
        self.merged(rows).write.parquet(f"{self.path}/{base}")
        merged = dict(manifest["merged"])
        unmerged = self._changes(manifest)
        for epoch, batch, _ in unmerged:
            merged[str(epoch)] = max(batch, merged.get(str(epoch), -1))
        replaced = [name for _, _, name in unmerged] + ([manifest["base"]] if manifest["base"] else [])
        made = {"number": number, "base": base, "epoch": max(epoch for epoch, _, _ in changes), "merged": merged, "replaced": replaced}
        # Another writer that was faster has its own base; this one is then of no use.
        if not self.folder.write_new(_manifest_name(number), json.dumps(made)):
            self.folder.delete(base)
            return
        for name in manifest["replaced"]:
            self.folder.delete(name)

    def write(self, stream: DataFrame, checkpoint: str, once: bool = False, aggregate: Callable[[DataFrame], DataFrame] | None = None,
              interval: str = POLL_INTERVAL) -> StreamingQuery:
        """Start a stream that stores what each batch adds: ``aggregate`` of its rows."""
        epoch = change_epoch(self.spark, self.path, checkpoint)

        def save(batch: DataFrame, batch_id: int) -> None:
            self.save(aggregate(batch) if aggregate else batch, epoch, batch_id)

        writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        return writer.outputMode("append" if aggregate else "update").trigger(**trigger(once, interval)).start()
