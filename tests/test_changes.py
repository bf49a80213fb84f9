import datetime as dt
import time

import pytest
from helpers import at, log
from pyspark.sql import functions as F

from weblode.operators.filters import LogFilter, Settings
from weblode.operators.periods import Period
from weblode.sources.shared import SharedFolder
from weblode.streaming import changes
from weblode.streaming import rollup as rolling
from weblode.streaming.changes import ChangeTable, change_epoch
from weblode.streaming.late import LateWindows, micros
from weblode.streaming.pending import located_later
from weblode.streaming.rollup import HourRollup, answers


def counts(spark, **by_key):
    return spark.createDataFrame([(k, n) for k, n in by_key.items()], "k string, n bigint")


def figures(frame):
    return {r.k: r.n for r in frame.collect()}


@pytest.fixture
def table(spark, tmp_path):
    return ChangeTable(spark, str(tmp_path / "table"), ("k",), {"n": "sum"}, compact_every=3)


def test_changes_add_up_and_are_merged(spark, table):
    for batch in range(7):
        assert table.save(counts(spark, a=1, **{f"b{batch}": 2}), 0, batch)
        assert figures(table.read())["a"] == batch + 1
    manifest = table.manifest()
    assert manifest["number"] == 2 and manifest["merged"] == {"0": 5}
    # The folders that the first merge took in are gone, those of the last one wait for the next.
    assert table.folder.names("changes") == [f"000000-{b:012d}" for b in (3, 4, 5, 6)]
    assert figures(table.read(F.col("k") == "b3")) == {"b3": 2}
    assert figures(table.read_some(spark.createDataFrame([("a",), ("zz",)], "k string"))) == {"a": 7}


def test_a_batch_costs_the_same_however_many_came_before(spark, table, monkeypatch):
    table.compact_every = 1
    listed, merges, names, merged = [], [], SharedFolder.names, ChangeTable.merged
    monkeypatch.setattr(SharedFolder, "names", lambda self, folder="": listed.append(folder) or names(self, folder))
    monkeypatch.setattr(ChangeTable, "merged", lambda self, rows: merges.append(merged(self, rows)) or merges[-1])
    for batch in range(2):
        table.save(counts(spark, a=1), 0, batch)
    listed.clear()
    for batch in range(2, 5):
        table.save(counts(spark, a=1), 0, batch)
    assert table.manifest()["number"] == 5 and "manifests" not in listed
    # What fits one task is merged without a shuffle, whatever is larger with one.
    assert len(merges) == 5 and not any("Exchange" in m._jdf.queryExecution().executedPlan().toString() for m in merges)
    monkeypatch.setattr(changes, "SMALL_BYTES", 0)
    table.save(counts(spark, a=1, b=2), 0, 5)
    assert "Exchange" in merges[-1]._jdf.queryExecution().executedPlan().toString()
    assert figures(table.read()) == {"a": 6, "b": 2}


def test_a_writer_sees_the_manifests_of_others(spark, table):
    other = ChangeTable(spark, table.path, ("k",), {"n": "sum"}, compact_every=1)
    table.save(counts(spark, a=1), 0, 0)
    table.compact()
    for batch in (1, 2, 3):
        other.save(counts(spark, a=1), 0, batch)
    assert table.manifest() == other.manifest() and table.manifest()["number"] == 4
    assert not table.save(counts(spark, a=1), 0, 3) and figures(table.read()) == {"a": 4}
    # A table that begins anew under the same path is read anew.
    table.folder.delete("")
    assert table.manifest()["number"] == 0
    table.save(counts(spark, a=9), 0, 0)
    assert figures(table.read()) == {"a": 9}


def test_a_batch_that_runs_again_changes_nothing(spark, table):
    table.save(counts(spark, a=1), 0, 0)
    assert not table.save(counts(spark, a=1), 0, 0)
    for batch in (1, 2):
        table.save(counts(spark, a=1), 0, batch)
    assert table.manifest()["merged"] == {"0": 2} and not table.save(counts(spark, a=1), 0, 2)
    assert figures(table.read()) == {"a": 3}


def test_an_unfinished_change_is_not_read(spark, table):
    table.save(counts(spark, a=1), 0, 0)
    table.save(counts(spark, a=5), 0, 1)
    table.folder.delete("changes/000000-000000000001/_SUCCESS")
    assert figures(table.read()) == {"a": 1}
    assert table.save(counts(spark, a=5), 0, 1) and figures(table.read()) == {"a": 6}


def test_a_new_checkpoint_replaces_or_adds(spark, table, tmp_path):
    first, second = (change_epoch(spark, table.path, str(tmp_path / name)) for name in ("one", "two"))
    assert (first, second) == (0, 1) and change_epoch(spark, table.path, str(tmp_path / "one")) == 0
    for batch in range(4):
        table.save(counts(spark, a=1, old=1), first, batch)
    table.save(counts(spark, a=1), second, 0)
    assert figures(table.read()) == {"a": 1}
    adding = ChangeTable(spark, table.path, ("k",), {"n": "sum"}, restart="add")
    assert figures(adding.read()) == {"a": 5, "old": 4}
    for batch in (1, 2):
        table.save(counts(spark, a=1), second, batch)
    assert table.manifest()["epoch"] == 1 and figures(table.read()) == {"a": 3}


def test_newest_values_win_over_restarted_batch_numbers(spark, tmp_path):
    newest = ChangeTable(spark, str(tmp_path / "t"), ("k",), {"n": "newest"}, compact_every=2, restart="add")
    for epoch, batch, n in ((0, 0, 5), (0, 1, 7), (0, 2, 9), (1, 0, 2), (1, 1, 3)):
        newest.save(counts(spark, a=n), epoch, batch)
        assert figures(newest.read()) == {"a": n}


def test_empty_table_and_shared_files(spark, tmp_path):
    folder = SharedFolder(spark, str(tmp_path / "f"))
    assert folder.names() == [] and folder.write_new("a/b", "x\ny") and not folder.write_new("a/b", "z")
    assert folder.read("a/b") == "x\ny" and folder.names("a") == ["b"]
    table = ChangeTable(spark, str(tmp_path / "t"), ("k",), {"n": "sum"})
    table.save(counts(spark, a=1).limit(0), 0, 0)
    table.compact()
    assert table.read().count() == 0


def put(spark, folder, rows):
    log(spark, rows).write.mode("append").parquet(folder)


@pytest.fixture
def stream_of(spark, tmp_path):
    """A folder of log rows, and a stream over it."""
    folder = str(tmp_path / "rows")
    schema = log(spark, []).schema
    return folder, lambda: spark.readStream.schema(schema).parquet(folder)


def test_late_rows_mend_closed_windows(spark, tmp_path, stream_of):
    folder, stream = stream_of
    windows = LateWindows(spark, str(tmp_path / "w"), "1 hour", "10 minutes")

    def run(*rows):
        put(spark, folder, rows)
        windows.write(stream(), str(tmp_path / "c"), once=True).awaitTermination()
        return {r.bucket.hour: (r.requests, r.users) for r in windows.closed().collect()}

    day = "2024-01-10 "
    first = run({"ts": at(day + "08:10:00")}, {"ts": at(day + "09:20:00"), "user_agent": "b"}, {"ts": at(day + "10:05:00")}, {"ts": None})
    assert first == {8: (1, 1)} and windows.watermark() == at(day + "09:55:00")
    assert run({"ts": at(day + "09:40:00")}, {"ts": at(day + "08:50:00"), "user_agent": "c"}) == {8: (2, 2)}
    assert run({"ts": at(day + "12:30:00")}) == {8: (2, 2), 9: (2, 2), 10: (1, 1)}
    # Days later, for a window that never had a row, and once more for one that is closed.
    assert run({"ts": at("2024-01-09 07:00:00")}, {"ts": at(day + "09:59:59")})[7] == (1, 1)
    assert run({"ts": at(day + "09:10:00"), "user_agent": "b"})[9] == (4, 2)
    assert sorted(r.ts for r in windows.late_rows().collect()) == sorted(
        at(x) for x in ("2024-01-09 07:00:00", day + "08:50:00", day + "09:10:00", day + "09:59:59")
    )
    assert {r.bucket.hour: r.requests for r in windows.current().collect()} == {7: 1, 8: 2, 9: 4, 10: 1, 12: 1}
    with pytest.raises(ValueError):
        micros("a while")


def test_requests_wait_for_their_location(spark, tmp_path, stream_of):
    folder, stream = stream_of
    places, checkpoint, out = str(tmp_path / "places"), str(tmp_path / "c"), str(tmp_path / "points")
    kind, states = "ip_address string, lat double, lon double, located_at timestamp", []

    def run(rows, located):
        put(spark, folder, [{"ip_address": ip, "ts": at(f"2024-01-10 08:00:0{s}"), "status": 200 + s} for ip, s in rows])
        spark.createDataFrame([(ip, x, x, at("2024-01-10 09:00:00")) for ip, x in located], kind).write.mode("append").parquet(places)
        points = located_later(stream(), spark.readStream.schema(kind).parquet(places), salts=2)
        query = points.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        states.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
        return sorted((r.status, r.lat) for r in spark.read.parquet(out).collect())

    assert run([("a", 1), ("b", 2)], [("b", 2.0)]) == [(202, 2.0)]
    assert run([("a", 3), ("b", 4)], [("c", 3.0), ("d", None)]) == [(202, 2.0), (204, 2.0)]
    # The location of a comes: both of its requests are placed, and those after it at once.
    assert run([("d", 5)], [("a", 1.0)]) == [(201, 1.0), (202, 2.0), (203, 1.0), (204, 2.0)]
    assert run([("a", 6)], []) == [(201, 1.0), (202, 2.0), (203, 1.0), (204, 2.0), (206, 1.0)]
    # Requests that are placed leave the state; what stays is one location for each key and the request of d.
    assert run([("a", 7), ("a", 8), ("b", 9)], [])[-3:] == [(207, 1.0), (208, 1.0), (209, 2.0)] and states[-1] == states[-2]


def test_requests_of_unknown_addresses_are_given_up(spark, tmp_path, stream_of):
    folder, stream = stream_of
    places, out = str(tmp_path / "places"), str(tmp_path / "points")
    kind = "ip_address string, lat double, lon double, located_at timestamp"

    def run(row, located):
        put(spark, folder, [{"ip_address": ip, "ts": at("2024-01-10 08:00:00"), "status": n} for ip, n in row])
        spark.createDataFrame([(ip, 1.0, 1.0, at("2024-01-10 09:00:00")) for ip in located], kind).write.mode("append").parquet(places)
        points = located_later(stream(), spark.readStream.schema(kind).parquet(places), "1 second", salts=1)
        points.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.status for r in spark.read.parquet(out).collect())

    run([("a", 1)], [])
    time.sleep(2)
    run([("b", 2)], [])  # the watermark passes the timer of a
    time.sleep(1)
    assert run([("b", 3)], ["a", "b"])[-1] == 3 and run([("a", 4)], []) in ([2, 3, 4], [3, 4])


def test_filters_that_hourly_cells_decide():
    noon = dt.datetime(2024, 1, 31, 12)
    assert answers(LogFilter()) and answers(LogFilter(Period("week", noon), path="/", method="GET", status=200, version="v1", hour=3, day_of_week=2))
    assert answers(LogFilter(), Settings(ignore_404=True, ignore_params=True, excluded_endpoints=("/x",)))
    assert not answers(LogFilter(Period("week", noon.replace(minute=1)))) and not answers(LogFilter(Period("1 week", noon, "tui")))
    assert not answers(LogFilter(referrer="-")) and not answers(LogFilter(), Settings(exclude_bots=True)) and not answers(LogFilter(location="DE"))


def test_rollup_answers_without_the_rows(spark, tmp_path, stream_of):
    folder, stream = stream_of
    rows = [
        {"ts": at(f"2024-01-{10 + i % 5} {i % 24:02d}:{i % 60:02d}:00"), "path": f"/v{i % 3}/x?{i % 2}", "status": 200 + i % 4, "ip_address": str(i % 40), "response_size": i or None}
        for i in range(400)
    ]
    hourly = HourRollup(spark, str(tmp_path / "r"), compact_every=2)
    for first in (0, 150, 300):
        put(spark, folder, rows[first : first + 150])
        hourly.write(stream(), str(tmp_path / "c"), once=True).awaitTermination()
    whole = log(spark, rows)
    wanted = LogFilter(Period("week", dt.datetime(2024, 1, 19)), status=((200, 202),), version="v1")
    found = hourly.cells(wanted)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rolling.cells(wanted.apply(whole)).collect()))
    assert not any(folder in name for name in found.inputFiles())
    with pytest.raises(ValueError):
        hourly.cells(LogFilter(referrer="x"))
    assert hourly.cells(LogFilter(referrer="x"), stored=whole).count() == 0
    assert hourly.users().first().asDict() == {"requests": 400, "users": 40}
    part = hourly.users(at("2024-01-10 00:00:00"), at("2024-01-11 00:00:00")).first()
    assert part.requests == 80 and part.users == len({r["ip_address"] for r in rows if r["ts"].day == 10})
    sizes = {r.share: r.size for r in hourly.size_quantiles([0.0, 0.5, 1.0]).collect()}
    assert sizes[0.0] == 1 and sizes[1.0] == 399 and abs(sizes[0.5] - 200) <= 8
