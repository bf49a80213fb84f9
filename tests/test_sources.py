import gzip
import json
import os

import pytest
from helpers import at, log, plan
from pyspark.sql import functions as F

from checks import fixtures as fx
from weblode.operators import hosts, log_files
from weblode.operators.filters import LogFilter
from weblode.operators.lookup import lookup
from weblode.operators.periods import Period
from weblode.sources import files, hosts as host_source, networks, sinks


@pytest.fixture
def folder(tmp_path):
    def put(name, text):
        data = text.encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)

    put("access.log", "a1\n\n  \na2\r\n")
    put("access.log.1", "b1\n")
    put("access.log.2.gz", "c1\nc2\n")
    put("error.log", "e1\n")
    put("error.log.1.gz", "e2\n")
    put("notes.1", "no\n")
    put("access.log.old", "no\n")
    (tmp_path / "nested").mkdir()
    put("nested/access.log", "no\n")
    return str(tmp_path)


def values(df):
    return sorted(row.value for row in df.collect())


def test_read_folder(spark, folder):
    assert values(files.read_log_dir(spark, folder)) == ["a1", "a2\r", "b1", "c1", "c2"]
    assert values(files.read_log_dir(spark, folder, include_compressed=False)) == ["a1", "a2\r", "b1"]
    assert values(files.read_log_dir(spark, folder, "error")) == ["e1", "e2"]
    names = {row.source_file for row in files.read_log_dir(spark, folder).collect()}
    assert names == {"access.log", "access.log.1", "access.log.2.gz"}


def test_read_named_files(spark, folder):
    paths = [f"{folder}/{name}" for name in ("access.log.2.gz", "error.log", "notes.1")]
    access, error = files.read_named_files(spark, paths)
    assert values(access) == ["c1", "c2", "no"]
    assert values(error) == ["e1"]
    assert values(files.read_log_file(spark, f"{folder}/access.log")) == ["a1", "a2\r"]


def test_long_line(spark, tmp_path):
    (tmp_path / "access.log").write_text("x" * 300_000 + "\nshort\n")
    assert sorted(len(v) for v in values(files.read_log_dir(spark, str(tmp_path)))) == [5, 300_000]


def test_location_of_logs():
    assert files.log_location("/a/access.log", None) == "/a/access.log"
    assert files.log_location(None, "/a/errors") == "/a/errors"
    assert files.log_location(None, "/a/error.log") == files.DEFAULT_LOG_DIR
    assert files.log_location(None, "/a/error.log", "error") == "/a/error.log"


def test_catalog_and_summary(spark, tmp_path):
    for name, size in {"access.log": 100, "access.log.1": 200, "old.GZ": 50, "readme": 25}.items():
        (tmp_path / name).write_bytes(b"x" * size)
    (tmp_path / "nested").mkdir()
    catalog = files.log_file_catalog(spark, str(tmp_path))
    assert {(r.name, r.size, r.extension) for r in catalog.collect()} == {
        ("access.log", 100, ".log"), ("access.log.1", 200, ".1"), ("old.GZ", 50, ".gz"), ("readme", 25, ""),
    }
    assert tuple(log_files.file_summary(catalog).first()) == (375, 300, 50, 4, 2, 1)
    assert [r.name for r in log_files.largest_files(catalog).collect()][:2] == ["access.log.1", "access.log"]
    single = files.log_file_catalog(spark, str(tmp_path / "access.log"))
    assert tuple(log_files.file_summary(single).first()) == (100, 100, 0, 1, 1, 0)
    assert "content" not in plan(catalog).split("Physical Plan")[-1]


def test_csv(spark, tmp_path):
    rows = log(
        spark,
        [
            dict(ts=at("2024-06-15 09:30:00"), path="/api/users", ip_address="1.2.3.4", response_size=512),
            dict(ts=None, status=None, response_size=None, user_agent='Client, "quoted"\nnext line', referrer=""),
            dict(path='=IMPORTXML("https://example.com")', user_agent=" padded ", referrer="@r"),
        ],
    ).coalesce(1)
    sinks.write_csv(rows, str(tmp_path / "out"))
    (part,) = [name for name in os.listdir(tmp_path / "out") if name.endswith(".csv")]
    text = (tmp_path / "out" / part).read_text()
    assert text.startswith("timestamp,path,method,status,ipAddress,userAgent,responseSize,httpVersion,referrer\n")
    assert "2024-06-15T09:30:00.000Z,/api/users,GET,200,1.2.3.4,ua,512,HTTP/1.1,'-\n" in text
    assert ',/,GET,,1.1.1.1,"Client, ""quoted""\nnext line",,HTTP/1.1,\n' in text
    assert "'=IMPORTXML(\"\"https://example.com\"\")\"" in text
    assert ", padded ," in text and text.endswith("'@r\n")


def test_stored_table_is_pruned(spark, tmp_path):
    rows = log(spark, [dict(ts=at(f"2024-01-{day:02d} 10:00:00"), path=str(day)) for day in range(1, 11)] + [dict(ts=None)])
    for rebalance in (False, True):
        path = str(tmp_path / f"table-{rebalance}")
        sinks.write_log_table(rows, path, rebalance=rebalance)
        table = sinks.read_log_table(spark, path, at("2024-01-09 00:00:00"))
        recent = LogFilter(Period("24 hours", at("2024-01-10 12:00:00"))).apply(table).select("path")
        assert {r.path for r in recent.collect()} == {"10"}
        text = plan(recent)
        assert "PartitionFilters: [isnotnull(log_date" in text
        assert "GreaterThanOrEqual(ts," in text
        assert "user_agent" not in text.split("ReadSchema")[-1]
        assert spark.read.parquet(path).count() == 11


def test_host_samples(spark, tmp_path):
    sample = {
        "uptime": 5, "timestamp": "2024-01-01T00:00:00Z",
        "cpu": {"model": "m", "cores": 2, "speed": 1.0, "usage": 7.5, "coreUsage": [10, 20]},
        "memory": {"free": 1, "available": 1, "used": 3, "total": 4},
        "disk": [{"filesystem": "f", "size": 10, "used": 4, "mountedOn": "/"}],
    }
    (tmp_path / "samples.json").write_text(json.dumps(sample) + "\n")
    row = hosts.host_metrics(host_source.read_host_samples(spark, str(tmp_path))).first()
    assert (row.cpu_percent, row.memory_percent, row.disk_percent, row.host) == (15.0, 75.0, 40.0, "")


def test_networks_from_csv(spark, tmp_path):
    (tmp_path / "city.csv").write_text("network,country,city,lat,lon\n10.0.0.0/8,GB,London,51.5,-0.1\n")
    (tmp_path / "country.csv").write_text("network,country\n10.0.0.0/8,GB\n")
    row = networks.read_networks(spark, str(tmp_path / "city.csv")).first()
    assert (row.prefix, row.net.lo, row.city, row.lat) == (8, 10 << 24, "London", 51.5)
    spark.read.option("header", True).csv(str(tmp_path / "country.csv")).write.parquet(str(tmp_path / "country.parquet"))
    row = networks.read_networks(spark, None, str(tmp_path / "country.parquet")).first()
    assert (row.country, row.city, row.lat) == ("GB", "", None)
    with pytest.raises(ValueError, match="needed"):
        networks.read_networks(spark, None)


def input_records(spark, run):
    """Records read by the stages that ``run`` starts."""
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)

    def stages():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        found = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).inputRecords() for i in range(found.size())}

    before = max(stages(), default=-1)
    run()
    return sum(records for stage, records in stages().items() if stage > before)


def test_plans(spark, sf):
    """Shapes that matter at scale."""
    from checks import fixtures as fx
    from weblode.operators import activity, counts, sizes, totals

    history = hosts.host_history(hosts.host_metrics(fx.host_samples(spark, sf)))
    assert "WindowGroupLimit" in plan(history)

    table = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"))
    wanted = LogFilter(Period("week", fx.AS_OF)).to_column()
    assert "PushedFilters: [IsNotNull(ts)" in plan(table.where(wanted))

    access = fx.access_log(spark, sf)
    for frame in (totals.totals(access), activity.activity(access), counts.dimension_counts(access)):
        text = plan(frame)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "PythonUDF" not in text and "ArrowEvalPython" not in text
    for frame in (totals.totals(access), activity.activity(access)):
        assert "Expand" not in plan(frame).split("Physical Plan")[-1]

    # How often the events are read: once for the histogram, whose parts share one shuffle;
    # for the series, one more pass over the time column finds the span.
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "cast(floor(value * 100) AS bigint) AS response_size", "cast(user_id AS string) AS ip_address",
        "cast(ts AS timestamp) AS ts", "'ua' AS user_agent", "200 AS status",
    )
    places = spark.createDataFrame([("1", "A"), ("2", "B")], "ip_address string, country string")
    rows = events.count()
    for frame, passes in (
        (sizes.size_histogram(events), 1),
        (activity.activity(events), 2),
        (lookup(events, places, "ip_address", ["country"]), 2),
    ):
        assert round(input_records(spark, frame.collect) / rows, 1) == passes


def test_files_written_in_order_by_slices(spark, tmp_path, monkeypatch):
    """Small slices make many tasks; the files hold the rows of their part in order all the same."""
    monkeypatch.setattr(fx, "SLICE_ROWS", 7)
    rows = spark.range(100).select((F.lit(99) - F.col("id")).alias("event_id")).withColumns({"part": F.expr("event_id % 3"), "value": F.expr("concat('line ', event_id)")})
    monkeypatch.setattr(fx, "access_lines", lambda *_: rows.drop("part"))
    monkeypatch.setattr(fx, "error_lines", lambda *_: rows.drop("part"))
    monkeypatch.setattr(fx, "shared_dir", lambda _: str(tmp_path))
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("in-order", "files in order")
    folder = fx.write_named_files(spark, "")
    stages = [s for j in status.getJobIdsForGroup("in-order") for s in status.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Rows are sorted by one task for every seven of them, not by one a file.
    assert max(info.numTasks for s in stages if (info := status.getStageInfo(s))) >= 15
    for number in range(3):
        with open(f"{folder}/access-{number}.log") as file:
            assert file.read() == "".join(f"line {i}\n" for i in range(number, 100, 3))
    assert sorted(os.listdir(folder)) == sorted(f"{kind}-{n}.log" for kind in ("access", "error") for n in range(3))
