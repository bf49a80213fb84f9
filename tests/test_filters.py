import pytest
from helpers import at, log
from pyspark.sql import functions as F

from weblode.functions import user_agent
from weblode.operators import errors, filters, periods
from weblode.operators.filters import ErrorFilter, LogFilter, Settings
from weblode.operators.parse import derive_labels, derive_time
from weblode.operators.periods import Period

NOW = at("2024-03-31 12:00:00")


def kept(df, wanted, settings=Settings(), **kwargs):
    return {row.path for row in wanted.apply(df, settings, **kwargs).collect()}


@pytest.fixture(scope="module")
def edges(spark):
    return log(
        spark,
        [
            dict(path="now", ts=NOW),
            dict(path="hour", ts=at("2024-03-31 11:00:00")),
            dict(path="two days", ts=at("2024-03-29 12:00:00")),
            dict(path="week", ts=at("2024-03-24 12:00:00")),
            dict(path="month", ts=at("2024-02-29 12:00:00")),
            dict(path="old", ts=at("2023-01-01 00:00:00")),
            dict(path="none", ts=None),
        ],
    )


def test_tui_periods_exclude_their_start(edges):
    period = lambda name: LogFilter(Period(name, NOW, "tui"))
    assert kept(edges, period("1 hour")) == {"now"}
    assert kept(edges, period("24 hours")) == {"now", "hour"}
    assert kept(edges, period("1 week")) == {"now", "hour", "two days"}
    assert kept(edges, LogFilter(Period(profile="tui"))) == {"now", "hour", "two days", "week", "month", "old"}


def test_web_periods_include_their_start(edges):
    period = lambda name: LogFilter(Period(name, NOW))
    assert kept(edges, period("1 hour")) == {"now", "hour"}
    assert kept(edges, period("week")) == {"now", "hour", "two days", "week"}
    # The month before 31 March starts on 29 February.
    assert kept(edges, period("month")) == {"now", "hour", "two days", "week", "month"}
    assert "none" in kept(edges, LogFilter())


def test_unknown_period_is_refused():
    with pytest.raises(ValueError, match="unknown period"):
        Period("fortnight", NOW)
    with pytest.raises(ValueError, match="as_of"):
        Period("week")


@pytest.fixture(scope="module")
def rows(spark):
    chrome = "Mozilla/5.0 (Windows NT 10.0) Chrome/1"
    base = log(
        spark,
        [
            dict(path="/api/users", status=200, user_agent=chrome),
            dict(path="/api/users?x=1", status=404, method="POST", referrer="r"),
            dict(path="/v1/a", status=None, ip_address="2.2.2.2", user_agent="Googlebot"),
            dict(path="/v2/a", status=503, ip_address="", ts=at("2024-01-07 23:00:00")),
        ],
    )
    return derive_labels(derive_time(base)).withColumn("country", F.when(F.col("ip_address") == "2.2.2.2", "GB"))


CASES = [
    (dict(status=404), {}, {"/api/users?x=1"}),
    (dict(status=((200, 299), (500, 599))), {}, {"/api/users", "/v2/a"}),
    (dict(), dict(ignore_404=True), {"/api/users", "/v1/a", "/v2/a"}),
    (dict(), dict(exclude_bots=True), {"/api/users", "/api/users?x=1", "/v2/a"}),
    (dict(path="/api/users"), dict(ignore_params=True), {"/api/users"}),
    (dict(method="POST", referrer="r"), {}, {"/api/users?x=1"}),
    (dict(version="v1"), {}, {"/v1/a"}),
    (dict(client="Chrome", os="Windows 10/11", device_type="Windows"), {}, {"/api/users"}),
    (dict(hour=23, day_of_week=0), {}, {"/v2/a"}),
    (dict(location="GB"), {}, {"/v1/a"}),
    (dict(), dict(excluded_endpoints=("/api/users",)), {"/api/users?x=1", "/v1/a", "/v2/a"}),
    (dict(), dict(excluded_endpoints=("/api/users",), ignore_params=True), {"/v1/a", "/v2/a"}),
]


@pytest.mark.parametrize(("fields", "settings", "expected"), CASES)
def test_each_filter(rows, fields, settings, expected):
    assert kept(rows, LogFilter(**fields), Settings(**settings)) == expected


def test_location_by_lookup(spark, rows):
    places = spark.createDataFrame([("2.2.2.2", "GB"), ("1.1.1.1", "FR")], "ip_address string, country string")
    bare = rows.drop("country")
    assert kept(bare, LogFilter(location="GB"), locations=places) == {"/v1/a"}
    assert LogFilter(location="FR").apply(bare, locations=places).count() == 2


def test_excluded_paths_from_a_table(spark, rows):
    paths = spark.createDataFrame([("/api/users",), ("/v1/a",)], "path string")
    assert {r.path for r in filters.exclude_endpoints(rows, paths, Settings(ignore_params=True)).collect()} == {"/v2/a"}


def test_endpoint_triple_and_lookup(rows):
    assert rows.where(filters.at_endpoint("/v1/a", "GET", 200)).count() == 0
    assert rows.where(filters.at_endpoint("/api/users", "GET", 200)).count() == 1
    assert rows.where(filters.by_lookup("user_agent", lambda c: user_agent.client(c, "tui"), "Chrome")).count() == 1


def test_error_filter(spark):
    table = spark.createDataFrame(
        [("ERROR", "Upstream Failed", NOW), ("warn", "slow", NOW), ("info", "failed", at("2020-01-01 00:00:00"))],
        "level string, message string, ts timestamp",
    )
    for name in ("client_address", "server_address", "request", "referrer", "host"):
        table = table.withColumn(name, F.lit(None).cast("string"))
    count = lambda **f: errors.search_errors(table, ErrorFilter(**f)).count()
    assert count(search="FAILED") == 2
    assert count(search="failed", period=Period("week", NOW)) == 1
    assert count(levels=("error", "warn")) == 2
    assert count() == 3
    assert [r.level for r in errors.sort_errors(table, "level", True).collect()] == ["ERROR", "info", "warn"]
    assert {r.level: r.n for r in errors.severity_counts(table).collect()} == {"error": 1, "warn": 1, "info": 1}


def test_initial_period(spark):
    first = lambda df, profile="web": periods.initial_period(df, NOW, profile).first().period
    assert first(log(spark, [dict(ts=at("2024-03-31 01:00:00")), dict(ts=None)])) == "24 hours"
    assert first(log(spark, [dict(ts=at("2024-03-10 01:00:00"))])) == "month"
    assert first(log(spark, [dict(ts=at("2020-03-10 01:00:00"))])) == "all time"
    mixed = log(spark, [dict(ts=at("2024-03-10 01:00:00")), dict(ts=at("2024-03-31 01:00:00"))])
    assert first(mixed, "tui") == "30 days"
