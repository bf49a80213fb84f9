import time

import pytest
from helpers import at, log, plan
from pyspark.sql import functions as F

from checks import fixtures as fx, stream_checks
from weblode.operators import activity
from weblode.operators.parse import parse_access
from weblode.sources import tail
from weblode.streaming import streams


@pytest.fixture
def tailed(spark, tmp_path):
    """Run the tail source once over a folder and return what it delivered so far."""
    folder, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()

    def run(**options):
        stream = tail.tail_logs(spark, str(folder), **options)
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(row.value for row in spark.read.parquet(out).collect())

    return folder, run


def test_tail_follows_appends_and_holds_partial_lines(tailed):
    folder, run = tailed
    path = folder / "access.log"
    path.write_text("one\ntwo\n\npart")
    (folder / "error.log").write_text("no\n")
    (folder / "access.log.2.gz").write_bytes(b"no\n")
    assert run() == ["one", "two"]
    assert run() == ["one", "two"]
    with path.open("a") as file:
        file.write("ial\nthree\n")
    (folder / "access.log.1").write_text("older\n")
    assert run() == ["older", "one", "partial", "three", "two"]


def test_tail_restarts_after_truncation_and_replacement(tailed):
    folder, run = tailed
    path = folder / "access.log"
    path.write_text("first line\nsecond\n")
    run()
    path.write_text("short\n")
    assert run() == ["first line", "second", "short"]
    path.write_text("a longer file took its place\nwith more\n")
    assert run() == ["a longer file took its place", "first line", "second", "short", "with more"]


def test_tail_splits_cover_each_line_once(tailed):
    folder, run = tailed
    lines = [f"{i:04d}" + "x" * (i * 7 % 50) for i in range(300)]
    (folder / "access.log").write_text("\n".join(lines) + "\n")
    assert run(split_bytes=97) == lines


def test_tail_fails_when_bytes_are_gone(tmp_path):
    path = tmp_path / "access.log"
    path.write_text("one\ntwo\n")
    reader = tail.LogTailReader(f"file://{tmp_path}", "access", 100)
    (part,) = reader.partitions({}, reader.latestOffset())
    path.write_text("o\n")
    with pytest.raises(OSError, match="gone"):
        list(reader.read(part))


def test_tail_notices_a_replacement_with_the_same_first_line(tailed):
    folder, run = tailed
    path = folder / "access.log"
    path.write_text("head\nx1\n")
    assert run() == ["head", "x1"]
    path.write_text("head\nyyyyyy\nzz\n")
    assert run() == ["head", "head", "x1", "yyyyyy", "zz"]


def test_tail_knows_rotated_files(tailed):
    folder, run = tailed
    path = folder / "access.log"
    path.write_text("a1\na2\n")
    run()
    with path.open("a") as file:
        file.write("a3\n")
    path.rename(folder / "access.log.1")
    path.write_text("b1\n")
    assert run() == ["a1", "a2", "a3", "b1"]
    (folder / "access.log.1").rename(folder / "access.log.2")
    path.rename(folder / "access.log.1")
    path.write_text("c1\n")
    assert run() == ["a1", "a2", "a3", "b1", "c1"]
    # Copied and truncated.
    (folder / "access.log.3").write_text(path.read_text())
    path.write_text("")
    assert run() == ["a1", "a2", "a3", "b1", "c1"]


def test_tail_reads_a_range_whose_file_was_renamed(tmp_path):
    path = tmp_path / "access.log"
    path.write_text("one\ntwo\n")
    reader = tail.LogTailReader(f"file://{tmp_path}", "access", 100)
    (part,) = reader.partitions({}, reader.latestOffset())
    path.rename(tmp_path / "access.log.1")
    path.write_text("new\n")
    assert [x for batch in reader.read(part) for x in batch.column(0).to_pylist()] == ["one", "two"]
    (tmp_path / "access.log.1").unlink()
    with pytest.raises(OSError, match="gone"):
        list(reader.read(part))
    assert list(tail.LogTailReader(str(tmp_path), "access", 100, fail_on_loss=False).read(part)) == []


def test_tail_opens_only_changed_files(tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"access{i}.log").write_text("x\n")
    reader = tail.LogTailReader(str(tmp_path), "access", 100)
    first = reader.latestOffset()
    looked, complete_end = [], tail.complete_end
    monkeypatch.setattr(tail, "complete_end", lambda path: looked.append(path) or complete_end(path))
    with (tmp_path / "access1.log").open("a") as file:
        file.write("y\n")
    second = reader.latestOffset()
    assert [p[-11:] for p in looked] == ["access1.log"] and second["access0.log"] == first["access0.log"]
    assert [(p.first, p.last) for p in reader.partitions(first, second)] == [(2, 4)]


def test_stream_of_parts_equals_batch(spark, sf, tmp_path):
    """Lines appended in pieces, cut inside a line, give the activity of all lines."""
    lines = [row.value for row in fx.access_lines(spark, sf).orderBy("event_id").collect()]
    text = "\n".join(lines) + "\n"
    folder, users = tmp_path / "logs", str(tmp_path / "users")
    folder.mkdir()
    cuts = [0, len(text) // 3 + 11, len(text) // 2 + 5, len(text)]
    for low, high in zip(cuts, cuts[1:]):
        with open(folder / "access.log", "a") as file:
            file.write(text[low:high])
        windows = streams.user_windows(streams.access_stream(spark, str(folder)), "1 day")
        streams.write_changes(windows, users, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    got = streams.windows_from_users(streams.read_changes(spark, users, *streams.USER_KEYS))
    batch = activity.bucket_counts(parse_access(fx.access_lines(spark, sf)), F.lit(86400))
    columns = ["bucket", "requests", "users", "success", "total"]
    assert sorted(got.select(columns).collect()) == sorted(batch.select(columns).collect())


def test_rotated_and_error_streams(spark, tmp_path):
    import gzip

    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "access.log").write_text("live\n")
    (folder / "access.log.1").write_text("one\n\n")
    (folder / "access.log.2.gz").write_bytes(gzip.compress(b"two\n"))
    (folder / "error.log.1").write_text("bad\n")
    (folder / "error.log").write_text("2024/03/15 12:00:00 [warn] 42#0: *1 something happened\n")

    def collected(stream, name):
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / name))
        writer = writer.option("checkpointLocation", str(tmp_path / f"{name}-checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    assert sorted(r.value for r in collected(streams.rotated_stream(spark, str(folder)), "a").collect()) == ["one", "two"]
    assert [r.value for r in collected(streams.rotated_stream(spark, str(folder), "error"), "b").collect()] == ["bad"]
    errors = collected(streams.error_stream(spark, str(folder)), "c")
    assert {(r.level, r.message) for r in errors.collect()} == {("warn", "something happened"), ("unknown", "bad")}


def batches(spark, tmp_path, name, schema, *parts):
    """A streaming frame with one micro-batch per part."""
    folder = tmp_path / name
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


ROWS = "ts timestamp, ip_address string, user_agent string, status int"


def run_append(spark, tmp_path, stream):
    out = str(tmp_path / "appended")
    writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("approximate", [True, False])
def test_closed_windows_are_emitted_once(spark, tmp_path, approximate):
    parts = [
        [(at("2024-01-01 10:05:00"), "a", "x", 200), (at("2024-01-01 10:06:00"), "a", "x", 200)],
        [(at("2024-01-01 10:50:00"), "b", "x", 200), (at("2024-01-01 11:10:00"), "b", "x", 200)],
        [(at("2024-01-01 15:00:00"), "c", "x", 500)],
        [(at("2024-01-01 16:00:00"), "c", "x", 500)],
    ]
    stream = batches(spark, tmp_path, "in", ROWS, *parts)
    got = run_append(spark, tmp_path, streams.closed_windows(stream, "1 hour", "30 minutes", approximate)).collect()
    seen = {row.bucket: (row.requests, row.users) for row in got}
    assert len(got) == len(seen)
    assert seen[at("2024-01-01 10:00:00")] == (3, 2)
    assert seen[at("2024-01-01 11:00:00")] == (1, 1)


def test_rows_wait_for_their_location(spark, tmp_path):
    rows = batches(
        spark, tmp_path, "rows", ROWS,
        [(at("2024-01-01 10:00:00"), "a", "x", 200), (at("2024-01-01 10:00:00"), "b", "x", 404)],
        [(at("2024-01-01 10:10:00"), "a", "x", 500)],
    )
    places = batches(
        spark, tmp_path, "places", "ip_address string, lat double, lon double, located_at timestamp",
        [("c", 9.0, 9.0, at("2024-01-01 10:00:00")), ("b", None, None, at("2024-01-01 10:00:00"))],
        [("a", 1.0, 2.0, at("2024-01-01 10:20:00"))],
    )
    got = run_append(spark, tmp_path, streams.located(rows, places, "1 hour"))
    assert sorted((r.lat, r.lon, r.status) for r in got.collect()) == [(1.0, 2.0, 200), (1.0, 2.0, 500)]


def test_compressed_backfill(spark, tmp_path):
    import gzip

    folder = tmp_path / "logs"
    folder.mkdir()
    line = '1.1.1.1 - - [10/Jan/2024:08:30:00 +0000] "GET /{} HTTP/1.1" 200 5 "-" "ua"\n'
    (folder / "access.log").write_text(line.format("live"))
    (folder / "access.log.2.gz").write_bytes(gzip.compress(line.format("old").encode()))
    streams.backfill_compressed(spark, str(folder), str(tmp_path / "table"))
    assert [row.path for row in spark.read.parquet(str(tmp_path / "table")).collect()] == ["/old"]


def test_newest_version_of_a_key(spark, tmp_path):
    path = str(tmp_path / "changes")
    for batch, rows in enumerate([[("a", 1), ("b", 1)], [("a", 4)]]):
        spark.createDataFrame(rows, "path string, n bigint").write.parquet(f"{path}/batch={batch}")
    got = streams.read_changes(spark, path, "path")
    assert {row.path: row.n for row in got.collect()} == {"a": 4, "b": 1}


def test_stored_stream_and_filter_change(spark, tmp_path):
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "ck")
    folder = tmp_path / "in"
    log(spark, [dict(path="/a"), dict(path="/b", status=500)]).write.parquet(str(folder))
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).parquet(str(folder))
    streams.append_rows(stream, table, checkpoint, once=True).awaitTermination()
    stored = spark.read.parquet(table)
    assert stored.where("status = 500").count() == 1
    assert "log_date" in plan(stored)


def test_tail_takes_no_more_than_the_limits(tmp_path):
    for name, n in (("access.log", 10), ("access.log.1", 4), ("access.log.2", 6)):
        (tmp_path / name).write_text("".join(f"{name} line {i:03d}\n" for i in range(n)))

    def drain(reader, start):
        """Lines of each batch until nothing is left, and the last offset."""
        batches = []
        while True:
            end = reader.latestOffset()
            parts = reader.partitions(start, end)
            if not parts:
                return batches, end
            batches.append([line for part in parts for batch in reader.read(part) for line in batch.column(0).to_pylist()])
            start = end

    reader = tail.LogTailReader(str(tmp_path), "access", 1 << 20, max_bytes=100)
    assert reader.initialOffset() == {}
    batches, end = drain(reader, {})
    assert sorted(x for b in batches for x in b) == sorted(f"{n} line {i:03d}" for n, k in (("access.log", 10), ("access.log.1", 4), ("access.log.2", 6)) for i in range(k))
    assert len(batches) > 3 and all(sum(len(x) + 1 for x in b) <= 100 for b in batches)
    # By files, and a line that is longer than the limit.
    (tmp_path / "access.log.3").write_text("x" * 500 + "\nshort\n")
    small = tail.LogTailReader(str(tmp_path), "access", 1 << 20, max_bytes=50, max_files=1)
    small._at = end
    batches, end = drain(small, end)
    assert [len(x) for b in batches for x in b] == [500, 5]
    one = tail.LogTailReader(str(tmp_path), "access", 1 << 20, max_files=1)
    one.initialOffset()
    assert sorted(len(b) for b in drain(one, {})[0]) == [2, 4, 6, 10]


def test_tail_limits_after_a_restart_and_a_rotation(tmp_path):
    logs, positions = tmp_path / "logs", str(tmp_path / "positions")
    logs.mkdir()
    (logs / "access.log").write_text("".join(f"a{i}\n" for i in range(20)))

    def reader(**options):
        return tail.LogTailReader(f"file://{logs}", "access", 1 << 20, max_bytes=12, positions=positions, **options)

    def step(one, start):
        end = one.latestOffset()
        parts = one.partitions(start, end)
        return end, [x for p in parts for b in one.read(p) for x in b.column(0).to_pylist()]

    first = reader()
    at, lines = step(first, first.initialOffset())
    assert lines == ["a0", "a1", "a2", "a3"]
    # The file is rotated before the rest of it is read, and a restarted source has only its notes.
    (logs / "access.log").rename(logs / "access.log.1")
    (logs / "access.log").write_text("b0\nb1\n")
    again, seen = reader(), list(lines)
    for _ in range(12):
        at, lines = step(again, at)
        assert sum(len(x) + 1 for x in lines) <= 12
        seen += lines
    assert sorted(seen) == sorted([f"a{i}" for i in range(20)] + ["b0", "b1"])
    # Without notes the first batch after a restart is not bounded.
    assert tail.LogTailReader(str(logs), "access", 1 << 20, max_bytes=4).latestOffset()["access.log.1"]["end"] == (logs / "access.log.1").stat().st_size


def test_tail_through_a_file_system(tailed, spark):
    folder, _ = tailed
    (folder / "access.log").write_text("one\n" + "y" * 3_000_000 + "\ntwo\n")
    reader = tail.LogTailReader(f"file://{folder}", "access", 1 << 20)
    parts = reader.partitions({}, reader.latestOffset())
    lines = [x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()]
    assert len(parts) == 3 and [len(x) for x in lines] == [3, 3_000_000, 3]


def test_rotation_batches_have_counted_columns_and_one_task(spark, tmp_path, monkeypatch):
    lines = spark.range(60).select(
        F.col("id").alias("event_id"),
        F.expr("""concat('10.0.0.1 - - [30/Jan/2024:10:00:00 +0000] "GET /', id, ' HTTP/1.1" ', 200 + id % 2, ' 5 "-" "curl/8"')""").alias("value"),
    )
    monkeypatch.setattr(fx, "access_lines", lambda *_: lines)
    seen, write = [], stream_checks.ChangeTable.write

    def watched(self, stream, checkpoint, once=False, aggregate=None, **options):
        def add(batch):
            seen.append((batch.columns, aggregate(batch)._jdf.queryExecution().executedPlan().toString()))
            return aggregate(batch)

        return write(self, stream, checkpoint, once, add, **options)

    monkeypatch.setattr(stream_checks.ChangeTable, "write", watched)
    found = stream_checks.replay_rotation(spark, "").collect()
    assert sorted((r.log_date, r.status, r.n) for r in found) == [("2024-01-30", 200, 30), ("2024-01-30", 201, 30)]
    # All columns of a batch are computed, so it must not carry labels; 400 kB need no shuffle.
    assert len(seen) >= 4 and all(columns == ["ts", "status"] and "Exchange" not in plan for columns, plan in seen)
