"""A streaming source that follows growing log files.

The file source of Spark takes a file once. This one keeps a byte position per
file as its offset, with checksums of the first line and of the bytes before the
position: a new file starts at 0, an unchanged file yields nothing, a line without
its newline waits, and a file whose bytes before the position changed starts over.
A file that was renamed (rotated) is known by its checksums and goes on from the
position it had under its old name. Ranges are cut into splits, so that one large
file is read by many tasks. A range whose file is renamed before it is read is found
by the same checksums; if its bytes are gone the read fails, or with
``failOnDataLoss`` false goes on without them. All executors must see the folder
under the same path; paths with a scheme go through the file system it names, and only
the bytes of a range are read.

``maxBytesPerTrigger`` and ``maxFilesPerTrigger`` bound a batch: files are taken in order
of name up to the limits, the others keep their position. Spark does not tell a Python
source where a restarted query stands, so limits on the first batch after a restart need
``positions``, a folder where the source notes each offset before it is read. With
``availableNow`` a limited source ends after one batch.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# --- fixed values -----------------------------------------------------------
PLAIN_PATTERN = r"\.log(\.\d+)?$"
ERROR_MARK = "error"
# --- end of fixed values ----------------------------------------------------

SCHEMA = "value string, source_file string"
SPLIT_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 1024 * 1024
TAIL_BYTES = 4096


@dataclass
class TailRange(InputPartition):
    """Lines that begin at ``first`` or later and before ``last``, within a range that starts at ``origin``."""

    path: str
    origin: int
    first: int
    last: int
    end: int
    mark: int
    tail: int


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _open(path: str) -> pa.NativeFile:
    system, inner = _system(path)
    return system.open_input_file(inner)


def complete_end(path: str, limit: int | None = None) -> int:
    """Position after the last newline of a file, or of its first ``limit`` bytes."""
    with _open(path) as file:
        at = file.size() if limit is None else min(limit, file.size())
        while at > 0:
            start = max(0, at - BLOCK_BYTES)
            newline = file.read_at(at - start, start).rfind(b"\n")
            if newline >= 0:
                return start + newline + 1
            at = start
    return 0


def line_end(path: str, start: int) -> int:
    """Position after the first newline from ``start`` on; ``start`` if there is none."""
    with _open(path) as file:
        for at in range(start, file.size(), BLOCK_BYTES):
            newline = file.read_at(BLOCK_BYTES, at).find(b"\n")
            if newline >= 0:
                return at + newline + 1
    return start


def first_line_mark(path: str) -> int:
    """Checksum of the first line; tells a replaced file from one that grew."""
    with _open(path) as file:
        head = file.read_at(min(BLOCK_BYTES, file.size()), 0)
        return zlib.crc32(head[: head.find(b"\n") + 1] or head)


def tail_mark(path: str, end: int) -> int:
    """Checksum of the last bytes before a position; -1 if the file is shorter."""
    with _open(path) as file:
        if file.size() < end:
            return -1
        first = max(0, end - TAIL_BYTES)
        return zlib.crc32(file.read_at(end - first, first))


def position(path: str, end: int) -> dict:
    """A position with the checksums by which its file is known again."""
    mark, tail = (first_line_mark(path), tail_mark(path, end)) if end else (0, 0)
    return {"end": end, "mark": mark, "tail": tail}


def holds(path: str, position: dict) -> bool:
    """Whether the file still begins with the bytes that a position was taken of."""
    if position["end"] <= 0 or first_line_mark(path) != position["mark"]:
        return False
    found = tail_mark(path, position["end"])
    return found >= 0 and found == position.get("tail", found)  # positions written by earlier versions have no tail


class LogTailReader(DataSourceStreamReader):
    def __init__(self, folder: str, kind: str, split_bytes: int, names: str = PLAIN_PATTERN, fail_on_loss: bool = True,
                 max_bytes: int = 0, max_files: int = 0, positions: str | None = None):
        self.folder = folder.rstrip("/") if "://" in folder else folder.removeprefix("file:")
        self.kind, self.split_bytes, self.names, self.fail_on_loss = kind, split_bytes, names, fail_on_loss
        self.max_bytes, self.max_files, self.positions = max_bytes, max_files, positions
        self._known: dict[str, tuple] = {}
        self._at: dict | None = None

    def _files(self) -> list[fs.FileInfo]:
        system, inner = _system(self.folder)
        found = sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda info: info.base_name)
        wants_errors = self.kind == "error"
        return [
            info for info in found
            if info.type == fs.FileType.File and re.search(self.names, info.base_name) and (ERROR_MARK in info.base_name) == wants_errors
        ]

    def initialOffset(self) -> dict:
        self._at = {}
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for info in self._files():
            path = os.path.join(self.folder, info.base_name)
            try:
                seen = (info.size, info.mtime_ns)
                # A file that has not changed since the last look is not opened.
                if self._known.get(info.base_name, (None,))[0] != seen:
                    self._known[info.base_name] = (seen, position(path, complete_end(path)))
            except FileNotFoundError:  # renamed between the listing and the look
                continue
            found[info.base_name] = self._known[info.base_name][1]
        if not (self.max_bytes or self.max_files):
            return found
        start = self._at if self._at is not None else self._noted()
        return found if start is None else self._admitted(start, found)

    def _admitted(self, start: dict, found: dict) -> dict:
        """As far as the limits let a batch go from ``start``; files beyond them keep their position."""
        taken, read, files = {}, 0, 0
        for name, new in found.items():
            path = os.path.join(self.folder, name)
            try:
                origin, full = self._origin(name, new, start), (self.max_files and files >= self.max_files) or (self.max_bytes and read >= self.max_bytes)
                end = origin if full else new["end"]
                if not full and self.max_bytes and end - origin > self.max_bytes - read:
                    # At least one line, so that a long one does not stop the stream.
                    end = max(complete_end(path, origin + self.max_bytes - read), origin)
                    if end == origin and not read:
                        end = line_end(path, origin)
                files, read = files + (end > origin), read + end - origin
                taken[name] = new if end == new["end"] else position(path, end)
            except FileNotFoundError:
                continue
        return taken

    def _note(self) -> str:
        return os.path.join(self.positions, f"{self.kind}.json")

    def _noted(self) -> dict | None:
        if not self.positions:
            return None
        try:
            with _open(self._note()) as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return None

    def _origin(self, name: str, new: dict, start: dict) -> int:
        """Where the unread bytes of a file begin: at its own position, at that of its old name, or at 0."""
        path = os.path.join(self.folder, name)
        old = start.get(name)
        if old == new:
            return new["end"]
        try:
            if old and holds(path, old):
                return old["end"]
            return max((p["end"] for other, p in start.items() if other != name and p["mark"] == new["mark"] and holds(path, p)), default=0)
        except FileNotFoundError:  # its range is found under its new name when it is read
            return old["end"] if old and old["mark"] == new["mark"] and old["end"] <= new["end"] else 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._at = end
        if self.positions:
            system, inner = _system(self._note())
            system.create_dir(os.path.dirname(inner), recursive=True)
            with system.open_output_stream(inner + ".draft") as file:
                file.write(json.dumps(end).encode())
            system.move(inner + ".draft", inner)
        ranges = []
        for name, new in end.items():
            origin = self._origin(name, new, start)
            for first in range(origin, new["end"], self.split_bytes):
                last = min(first + self.split_bytes, new["end"])
                ranges.append(TailRange(os.path.join(self.folder, name), origin, first, last, new["end"], new["mark"], new["tail"]))
        return ranges

    def _find(self, partition: TailRange) -> str | None:
        """The file that holds the range now: under its own name or, after a rotation, another one."""
        wanted = {"end": partition.end, "mark": partition.mark, "tail": partition.tail}
        own = os.path.basename(partition.path)
        system, inner = _system(self.folder)
        others = sorted(info.base_name for info in system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.File)
        for name in [own, *[n for n in others if n != own]]:
            path = os.path.join(self.folder, name)
            try:
                if holds(path, wanted):
                    return path
            except FileNotFoundError:
                continue
        return None

    def read(self, partition: TailRange) -> Iterator[pa.RecordBatch]:
        path = self._find(partition)
        if path is None:
            if self.fail_on_loss:
                raise OSError(f"bytes {partition.first} to {partition.last} of {partition.path} are gone")
            return
        name = os.path.basename(partition.path)
        with _open(path) as file:
            at = partition.first
            if at > partition.origin:
                # The line that spans the cut belongs to the split before.
                at = line_end(path, at - 1)
            while at < partition.last:
                block = file.read_at(min(BLOCK_BYTES, partition.last - at), at)
                if not block:
                    break
                if not block.endswith(b"\n"):
                    end = line_end(path, at + len(block))
                    block += file.read_at(end - at - len(block), at + len(block))
                at += len(block)
                lines = pc.split_pattern(pa.array([block.decode("utf-8", errors="replace")], pa.large_string()), "\n").flatten()
                lines = lines.filter(pc.match_substring_regex(lines, r"[^ \t\n\r\x0b\x0c]")).cast(pa.string())
                if len(lines):
                    yield pa.RecordBatch.from_arrays([lines, pa.array([name] * len(lines), pa.string())], ["value", "source_file"])

    def commit(self, end: dict) -> None:
        """Positions live in the checkpoint; nothing to release."""


class LogTail(DataSource):
    """Options: ``path``, ``kind`` (access or error), ``splitBytes``, ``names`` (a pattern), ``failOnDataLoss``, ``maxBytesPerTrigger``, ``maxFilesPerTrigger``, ``positions``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogTailReader:
        options = self.options
        return LogTailReader(
            options["path"],
            options.get("kind", "access"),
            int(options.get("splitBytes", SPLIT_BYTES)),
            options.get("names", PLAIN_PATTERN),
            options.get("failOnDataLoss", "true").lower() == "true",
            int(options.get("maxBytesPerTrigger", 0)),
            int(options.get("maxFilesPerTrigger", 0)),
            options.get("positions"),
        )


def register(spark: SparkSession) -> None:
    """Register the source; its code travels with the plan, so workers need no installation."""
    import weblode.sources.tail as this

    cloudpickle.register_pickle_by_value(this)
    spark.dataSource.register(LogTail)


def tail_logs(
    spark: SparkSession,
    path: str,
    kind: str = "access",
    split_bytes: int = SPLIT_BYTES,
    names: str = PLAIN_PATTERN,
    fail_on_loss: bool = True,
    max_bytes: int = 0,
    max_files: int = 0,
    positions: str | None = None,
) -> DataFrame:
    """Stream of complete lines appended to the plain logs of a folder; limits of 0 are none."""
    register(spark)
    reader = spark.readStream.format("log_tail").option("path", path).option("kind", kind)
    reader = reader.option("splitBytes", str(split_bytes)).option("names", names).option("failOnDataLoss", str(fail_on_loss).lower())
    reader = reader.option("maxBytesPerTrigger", str(max_bytes)).option("maxFilesPerTrigger", str(max_files))
    return (reader.option("positions", positions) if positions else reader).load()
