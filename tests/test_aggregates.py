"""Aggregates against plain Python on small random logs."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from helpers import at, log
from pyspark.sql import functions as F

from weblode.operators import activity, counts, geo, hosts, sizes, topk, totals
from weblode.operators.filters import LogFilter, Settings
from weblode.operators.lookup import hot_keys, lookup
from weblode.operators.parse import derive_time
from weblode.operators.periods import Period
from weblode.plans.report import traffic_report

START = at("2024-01-01 00:00:00")


def random_rows(seed, n, days=9, none_share=0.05):
    rng = random.Random(seed)
    # One address and one path hold a third of all rows.
    pick = lambda hot, others: hot if rng.random() < 0.34 else rng.choice(others)
    return [
        dict(
            ip_address=pick("9.9.9.9", [f"10.0.0.{i}" for i in range(20)]),
            ts=None if rng.random() < none_share else START + dt.timedelta(seconds=rng.randrange(days * 86400)),
            method=rng.choice(["GET", "POST"]),
            path=pick("/hot", ["/", "/a?x=1", "/a?x=2", "/api/v1/x", "/api/v2/x", "/c::d"]),
            status=None if rng.random() < none_share else rng.choice([101, 200, 201, 301, 404, 500]),
            response_size=rng.choice([None, 0, *[rng.randrange(1, 4000) for _ in range(8)]]),
            referrer=rng.choice(["", "-", "https://a", "https://b"]),
            user_agent=rng.choice(["curl/7", "", "Mozilla/5.0 (X11; Linux) Chrome/1", "Googlebot"]),
        )
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def rows():
    return random_rows(1, 700)


@pytest.fixture(scope="module")
def df(spark, rows):
    return log(spark, rows).repartition(3).cache()


def pairs(frame, *keys):
    return {tuple(row[k] for k in keys): row.n for row in frame.collect()}


def test_keyed_counts(df, rows):
    assert pairs(counts.endpoint_counts(df), "path", "method", "status") == Counter(
        (r["path"], r["method"], r["status"]) for r in rows
    )
    stripped = counts.endpoint_counts(df, Settings(ignore_params=True), "tui")
    assert pairs(stripped, "path", "method", "status") == Counter(
        (r["path"].split("?")[0], r["method"], r["status"]) for r in rows if r["status"] is not None
    )
    named = [r for r in rows if r["referrer"] not in ("", "-")]
    assert pairs(counts.referrer_counts(df), "referrer") == Counter((r["referrer"],) for r in named)
    assert pairs(counts.version_counts(df), "version").keys() == {("v1",), ("v2",)}
    clients = {"curl/7": "Curl", "": "Other", "Googlebot": "Other"}
    assert pairs(counts.label_counts(df, "client"), "client") == Counter(
        (clients.get(r["user_agent"], "Chrome"),) for r in rows
    )


def test_dense_counts(df, rows):
    timed = derive_time(df)
    assert pairs(counts.weekday_counts(timed), "day_of_week") == {
        (d,): sum(1 for r in rows if r["ts"] and r["ts"].isoweekday() % 7 == d) for d in range(7)
    }
    early = timed.where("hour < 3")
    assert [row.n for row in counts.hour_counts(early).orderBy("hour").collect()][3:] == [0] * 21
    slots = {row.slot: row.n for row in counts.time_of_day_counts(df, 30).collect()}
    assert slots == {
        s: sum(1 for r in rows if r["ts"] and (r["ts"].hour * 60 + r["ts"].minute) // 30 * 30 == s)
        for s in range(0, 1440, 30)
    }
    with pytest.raises(ValueError, match="divide"):
        counts.time_of_day_counts(df, 7)


def test_totals(df, rows):
    dated = [r for r in rows if r["ts"]]
    judged = [r for r in dated if r["status"] is not None]
    row = totals.totals(df).first()
    assert row.total_requests == len(rows)
    assert row.total_users == len({(r["ip_address"], r["user_agent"]) for r in dated})
    assert (row.success_total, row.success_count) == (len(judged), sum(200 <= r["status"] < 400 for r in judged))
    hours = (max(r["ts"] for r in dated) - min(r["ts"] for r in dated)).total_seconds() / 3600
    assert row.total_hours == pytest.approx(hours)
    assert row.requests_per_hour == pytest.approx(len(rows) / hours)
    sized = [r["response_size"] for r in rows if r["response_size"]]
    assert (row.size_min, row.size_max) == (min(sized), max(sized))
    assert row.size_avg == pytest.approx(sum(sized) / len(sized))
    tui = totals.totals(df, Period(profile="tui")).first()
    assert (tui.success_total, tui.total_hours) == (len(rows), math.floor(hours))
    assert tui.success_count == sum(1 for r in rows if r["status"] and 100 <= r["status"] < 400)


def test_totals_without_rows(df):
    none = df.where("false")
    row = totals.totals(none).first()
    assert (row.total_requests, row.success_rate, row.total_hours, row.first_label) == (0, None, 1.0, "")
    assert totals.totals(none, Period("week", START)).first().total_hours == 168.0
    assert totals.totals(none, Period(profile="tui")).first().success_rate == -1.0
    assert totals.success_percent(none).first().success_rate == 0.0
    assert sizes.size_histogram(none).count() == 0
    assert activity.activity(none).count() == 0
    assert activity.binned_success(none).where("rate = 0").count() == 50


def expected_histogram(values):
    ordered = sorted(v for v in values if v)
    low, high = ordered[math.floor(len(ordered) * 0.1)], ordered[math.floor(len(ordered) * 0.95)]
    inside = [v for v in ordered if low <= v <= high]
    if high - low <= 500:
        return {b: sum(v - low == b for v in inside) for b in range(high - low + 1)}
    width = (high - low) / 500
    found = Counter(499 if v >= high else min(math.floor((v - low) / width), 499) for v in inside)
    return {b: found[b] for b in range(500)}


@pytest.mark.parametrize("largest", [1, 30, 5000, 10_000_000_000_000])
def test_size_histogram(spark, largest):
    rng = random.Random(largest)
    values = [rng.randrange(0, largest + 1) for _ in range(400)] + [largest] * 150
    frame = log(spark, [dict(response_size=v) for v in values])
    got = {row.bin: row.n for row in sizes.size_histogram(frame).collect()}
    assert got == expected_histogram(values)


def test_exact_ranks(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.randrange(1, 50), rng.randrange(1, 2**20), rng.randrange(1, 2**40)]) for _ in range(500)]
    ranked = sizes.ranked_sizes(sizes.size_counts(log(spark, [dict(response_size=v) for v in values])))
    for row in ranked.collect():
        assert row.upto == sum(v <= row.size for v in values)
        assert row.rows == len(values)


def bucketed(rows, step):
    found = defaultdict(list)
    for r in rows:
        if r["ts"]:
            epoch = int((r["ts"] - at("1970-01-01 00:00:00")).total_seconds())
            found[epoch // step * step].append(r)
    return found


def check_series(frame, rows, step, low, none):
    found = bucketed(rows, step)
    epoch = dt.datetime(1970, 1, 1)
    seen = {int((row.bucket - epoch).total_seconds()): row for row in frame.collect()}
    for start, row in seen.items():
        inside = found.get(start, [])
        judged = [r for r in inside if r["status"] is not None]
        good = sum(low <= r["status"] < 400 for r in judged)
        assert (row.requests, row.users) == (len(inside), len({(r["ip_address"], r["user_agent"]) for r in inside}))
        assert (row.success, row.total) == (good, len(judged))
        assert row.rate == (pytest.approx(good / len(judged)) if judged else none)
    return found, seen


def test_activity_for_all_time(df, rows):
    found, seen = check_series(activity.activity(df), rows, 86400, 200, None)
    assert set(seen) == set(range(min(found), max(found) + 1, 86400))
    found, seen = check_series(activity.activity(df, Period(profile="tui")), rows, 900, 100, -1.0)
    assert set(seen) == set(range(min(found), max(found) + 1, 900))


def test_activity_for_a_period(df, rows):
    period = Period("week", at("2024-01-10 12:30:00"))
    inside = [r for r in rows if r["ts"] and r["ts"] >= at("2024-01-03 12:30:00")]
    _, seen = check_series(activity.activity(LogFilter(period).apply(df), period), inside, 3600, 200, None)
    assert len(seen) == 7 * 24 + 1


def test_trend_and_chunks(df, rows):
    found, seen = check_series(activity.trend(df), rows, 86400, 200, None)
    assert set(seen) == set(found)
    days = [seen[k] for k in sorted(seen)]
    size = math.ceil(len(days) / 6)
    chunks = [days[i : i + size] for i in range(0, len(days), size)]
    got = activity.consolidate(activity.trend(df)).orderBy("chunk").collect()
    assert [(r.requests, r.users) for r in got] == [(sum(d.requests for d in c), sum(d.users for d in c)) for c in chunks]
    rates = activity.consolidate_rates(activity.trend(df)).orderBy("chunk").collect()
    assert [r.rate for r in rates] == [
        pytest.approx(sum(d.success for d in c) / sum(d.total for d in c)) for c in chunks
    ]


def test_bins(df, rows):
    dated = [r for r in rows if r["ts"]]
    first, last = min(r["ts"] for r in dated), max(r["ts"] for r in dated)
    width = int((last - first).total_seconds()) * 10**9 // 50
    users = defaultdict(set)
    for r in dated:
        index = min(int((r["ts"] - first).total_seconds()) * 10**9 // width, 49)
        users[index].add((r["ip_address"], r["user_agent"]))
    got = activity.binned_requests(df).orderBy("bin").collect()
    assert [r.users for r in got] == [len(users[b]) for b in range(50)]
    assert sum(r.requests for r in got) == len(dated)


def test_success_bins_with_one_bucket(spark):
    one = log(spark, [dict(ts=at("2024-01-01 00:01:00"), status=s) for s in (200, 500, 404, 101)])
    got = activity.binned_success(one).collect()
    assert len(got) == 50 and {r.rate for r in got} == {0.5}
    alike = activity.binned_requests(log(spark, [dict(), dict()])).orderBy("bin").collect()
    assert [r.requests for r in alike] == [2] + [0] * 49


@pytest.mark.parametrize("columns", [3, 7, 20, 60])
def test_down_sample(spark, columns):
    rng = random.Random(columns)
    points = [(START + dt.timedelta(hours=i), rng.randrange(4), i, rng.choice([-1.0, 0.5, 1.0])) for i in range(20)]
    series = spark.createDataFrame(points, "bucket timestamp, requests bigint, users bigint, rate double")
    got = {r.column: r for r in activity.down_sample(series, columns).collect()}
    assert set(got) == set(range(columns))
    for i in range(columns):
        low = i * 20 // columns
        part = points[low : max((i + 1) * 20 // columns, low + 1)]
        best = max(part, key=lambda p: p[1])
        rates = [p[3] for p in part if p[3] >= 0]
        assert (got[i].requests, got[i].users) == (best[1], best[2] if best[1] else 0)
        assert got[i].rate == (pytest.approx(sum(rates) / len(rates)) if rates else -1.0)


def test_ranked_lists(spark, df):
    tied = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "client string, n bigint")
    assert [r.client for r in topk.top_labels(tied, "client", 2).collect()] == ["c", "a"]
    assert [r.share for r in topk.share_of_max(topk.top_labels(tied, "client")).orderBy("client").collect()] == [0.4, 0.4, 1]
    one = spark.createDataFrame([("v1", 3)], "version string, n bigint")
    assert topk.top_versions(one).count() == 0
    assert topk.top_versions(one, filtered=True).count() == 1
    assert topk.newest_rows(df, 5).where("ts IS NULL").count() == 0
    assert topk.one_method(df.where("false")).first().one_method is False


def test_report_counts_equal_separate_counts(spark, df):
    places = spark.createDataFrame([("9.9.9.9", "GB"), ("10.0.0.1", "")], "ip_address string, country string")
    for profile in ("web", "tui"):
        parts = traffic_report(df, LogFilter(Period(profile=profile)), locations=places, staged=True)
        rows = df if profile == "web" else df.where("ts IS NOT NULL")
        got = {(r.dimension, r.key, r.method, r.status): r.n for r in parts["counts"].collect()}
        of = lambda name: {k[1:]: n for k, n in got.items() if k[0] == name}  # noqa: E731, B023
        assert of("endpoint") == pairs(counts.endpoint_counts(rows, profile=profile), "path", "method", "status")
        referrers = {k if profile == "tui" else k[:1]: n for k, n in of("referrer").items()}
        names = ("referrer", "method", "status") if profile == "tui" else ("referrer",)
        assert referrers == pairs(counts.referrer_counts(rows, profile), *names)
        for name in ("client", "os", "device"):
            assert {k[:1]: n for k, n in of(name).items()} == pairs(counts.label_counts(rows, name, profile), name)
        assert {k[0]: n for k, n in of("location").items()} == {"GB": rows.where("ip_address = '9.9.9.9'").count()}
        assert {k[0] for k in of("unknown_ip")} == {f"10.0.0.{i}" for i in range(20)}
        assert parts["totals"].first().total_requests == rows.count()
        for frame in parts.values():
            frame.collect()


def test_report_under_a_filter_equals_report_on_filtered_rows(df):
    wanted = LogFilter(method="GET", status=((200, 299),))
    by_filter = traffic_report(df, wanted)["counts"].collect()
    beforehand = traffic_report(df.where("method = 'GET' AND status BETWEEN 200 AND 299"))["counts"].collect()
    assert sorted(by_filter, key=str) == sorted(beforehand, key=str)


def test_longest_prefix_wins(spark):
    blocks = [
        ("10.0.0.0/8", "A"), ("10.1.0.0/16", "B"), ("10.1.2.3", "C"), ("0.0.0.0/1", "Z"),
        ("2001:db8::/32", "D"), ("2001:db8:1::/48", "E"), ("2001:db8:1::7/128", "F"),
    ]
    networks = geo.networks_from_cidr(spark.createDataFrame(blocks, "network string, country string"))
    expected = {
        "10.9.9.9": "A", "10.1.9.9": "B", "10.1.2.3": "C", "9.0.0.1": "Z", "200.0.0.1": "", "2001:db8:2::1": "D",
        "2001:db8:1::8": "E", "2001:db8:1::7": "F", "2001:db9::": "", "::ffff:10.1.2.3": "C",
    }
    addresses = spark.createDataFrame([(a,) for a in expected], "ip_address string")
    assert {r.ip_address: r.country for r in geo.resolve(addresses, networks).collect()} == expected


def test_any_range_becomes_blocks(spark):
    rng = random.Random(3)
    ranges = [(5, 5, "a"), (7, 30, "b"), (2**32 - 40, 2**32 - 1, "c"), (1000, 1000 + rng.randrange(3000), "d")]
    networks = geo.networks_from_ranges(spark.createDataFrame(ranges, "network_lo bigint, network_hi bigint, country string"))
    numbers = [0, 4, 5, 6, 7, 30, 31, 999, *[rng.randrange(900, 4200) for _ in range(60)], 2**32 - 41, 2**32 - 40, 2**32 - 1]
    text = lambda n: ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    expected = {text(n): next((c for lo, hi, c in ranges if lo <= n <= hi), "") for n in numbers}
    addresses = spark.createDataFrame([(a,) for a in expected], "ip_address string")
    assert {r.ip_address: r.country for r in geo.resolve(addresses, networks).collect()} == expected


def test_locations(spark, df, rows):
    places = spark.createDataFrame(
        [("9.9.9.9", "GB", 1.0, 2.0), ("10.0.0.1", "", None, None), ("10.0.0.2", "FR", 3.0, None)],
        "ip_address string, country string, lat double, lon double",
    )
    hot = sum(r["ip_address"] == "9.9.9.9" for r in rows)
    assert pairs(counts.location_counts(df, places), "country")[("GB",)] == hot
    assert geo.with_location(df, places).where("country = 'GB'").count() == hot
    unknown = {r.ip_address for r in geo.unknown_addresses(df, places).collect()}
    assert "10.0.0.1" in unknown and "10.0.0.2" not in unknown
    assert "10.0.0.1" not in {r.ip_address for r in geo.unknown_addresses(df, places, "tui").collect()}
    points = geo.live_points(df, places, at("2024-01-10 00:00:00"), "7 DAYS").collect()
    assert len(points) == sum(r["ip_address"] == "9.9.9.9" and r["ts"] is not None and r["ts"] >= at("2024-01-03 00:00:00") for r in rows)
    names = spark.createDataFrame([("GB", "United Kingdom")], "country string, name string")
    named = geo.country_names(counts.location_counts(df, places), names)
    assert {r.country: r.name for r in named.collect()} == {"GB": "United Kingdom", "FR": None}
    top = topk.top_locations(counts.location_counts(df, places), 1).collect()
    assert [(r.country, r.locations) for r in top] == [("GB", 2)]


def test_lookup_spreads_hot_keys(spark, df, rows):
    table = spark.createDataFrame([("9.9.9.9", "GB"), ("10.0.0.1", "FR")], "ip_address string, country string")
    expected = Counter({"9.9.9.9": "GB", "10.0.0.1": "FR"}.get(r["ip_address"]) for r in rows)
    # 0.2: one hot address; 0.9: none; 0.0: all are hot; None: plain join.
    for share in (0.2, 0.9, 0.0, None):
        joined = lookup(df, table, "ip_address", ["country"], share)
        assert joined.columns == [*df.columns, "country"]
        assert Counter(r.country for r in joined.collect()) == expected
    assert [r.ip_address for r in hot_keys(df, "ip_address", 0.2).collect()] == ["9.9.9.9"]


def test_newest_rows(spark, df, rows):
    dated = sorted((r["ts"] for r in rows if r["ts"]), reverse=True)
    for n in (1, 37, len(dated), len(dated) + 5, len(rows) + 5):
        got = topk.newest_rows(df, n).collect()
        assert [r.ts for r in got] == (dated + [None] * (len(rows) - len(dated)))[:n]
    assert topk.newest_rows(df.where("ts IS NULL"), 3).count() == 3


def test_host_metrics_and_history(spark):
    schema = (
        "host string, timestamp timestamp, cpu struct<usage:double,core_usage:array<double>>, "
        "memory struct<used:bigint,total:bigint>, disk array<struct<mounted_on:string,size:bigint,used:bigint>>"
    )
    samples = spark.createDataFrame(
        [
            ("a", START + dt.timedelta(seconds=2 * i), (float(i), [10.0, 20.0]), (1, 4), [("/x", 9, 9), ("/", 10, 5)])
            for i in range(5)
        ]
        + [("b", START, (1.0, []), (0, 0), [("/x", 9, 9)])],
        schema,
    )
    rows = {(r.host, r.cpu_percent): r for r in hosts.host_metrics(samples).collect()}
    assert rows[("a", 15.0)].memory_percent == 25.0 and rows[("a", 15.0)].disk_percent == 50.0
    assert rows[("b", None)].disk_percent is None and rows[("b", None)].memory_percent is None
    web = hosts.host_metrics(samples, "web")
    assert web.where("host = 'b'").first().disk_percent == 0.0
    kept = hosts.host_history(web, samples=2).where("host = 'a'").orderBy(F.desc("ts")).collect()
    assert [r.cpu_percent for r in kept] == [4.0, 3.0]


@pytest.mark.parametrize("n", [0, 1, 5, 39, 40, 41, 70, 200, 500])
def test_newest_rows_of_a_crowded_second(spark, n):
    second = at("2024-01-10 08:30:00")
    rows = [{"ts": second, "path": f"/{i % 120:03d}"} for i in range(300)] + [{"ts": at(f"2024-01-10 {8 + i % 3:02d}:{i:02d}:31"), "path": "/x"} for i in range(30, 59)]
    rows += [{"ts": None, "path": f"/n{i}"} for i in range(40)]
    wanted = sorted(rows, key=lambda r: (r["ts"] is None, -(r["ts"] or second).timestamp(), r["path"]))[:n]
    got = topk.newest_rows(log(spark, rows), n, "path").collect()
    assert [(r.ts, r.path) for r in got] == [(r["ts"], r["path"]) for r in wanted]


def test_first_rows_come_from_many_tasks(spark):
    frame = spark.range(0, 1000, 1, 8).selectExpr("7 AS same", "id")
    kept = topk.first_rows(frame, 637, F.asc("same"))
    sizes = kept.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 637 and len(sizes) > 1
    assert topk.first_rows(frame, 0, F.asc("id")).count() == 0 and topk.first_rows(frame, 5000, F.asc("id")).count() == 1000
    assert sorted(r.id for r in topk.first_rows(frame, 10, F.desc("id")).collect()) == list(range(990, 1000))


def test_large_networks_are_looked_up_by_block(spark):
    networks = geo.networks_from_cidr(spark.createDataFrame(
        [("0.0.0.0/0", "ALL"), ("10.0.0.0/8", "TEN"), ("10.1.0.0/16", "ONE"), ("10.1.2.0/24", "TWO"), ("10.1.2.3/32", "SELF"), ("::/0", "SIX"), ("2001:db8::/32", "DOC"), ("2001:db8:0:1::/64", "NET")],
        "network string, country string",
    ))
    addresses = [f"10.{i % 7}.{i % 11}.{i % 250}" for i in range(3000)] + ["10.1.2.3", "192.0.2.1", "2001:db8::1", "2001:db8:0:1::9", "fe80::1", "no address"]
    frame = spark.createDataFrame([(a,) for a in set(addresses)], "ip_address string")
    import ipaddress

    tables = [(ipaddress.ip_network(n), c) for n, c in (
        ("0.0.0.0/0", "ALL"), ("10.0.0.0/8", "TEN"), ("10.1.0.0/16", "ONE"), ("10.1.2.0/24", "TWO"), ("10.1.2.3/32", "SELF"), ("::/0", "SIX"), ("2001:db8::/32", "DOC"), ("2001:db8:0:1::/64", "NET"),
    )]

    def country(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return ""
        return max(((n.prefixlen, c) for n, c in tables if n.version == ip.version and ip in n), default=(0, ""))[1]

    assert {(r.ip_address, r.country) for r in geo.resolve(frame, networks).collect()} == {(a, country(a)) for a in set(addresses)}
