"""The registered queries: name -> function of (session, folder with the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import stream_checks
from weblode.functions import formats, status, text, user_agent, versions
from weblode.operators import (
    activity,
    counts,
    error_parse,
    errors,
    filters,
    geo,
    hosts,
    log_files,
    parse,
    sizes,
    topk,
    totals,
)
from weblode.operators.filters import ErrorFilter, LogFilter, Settings
from weblode.operators.periods import Period, initial_period
from weblode.plans import report
from weblode.sources import files, sinks
from weblode.sources.hosts import read_host_samples
from weblode.sources.networks import read_networks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WEEK = Period("week", fx.AS_OF)
MONTH = Period("month", fx.AS_OF)
TUI_WEEK = Period("1 week", fx.AS_OF, "tui")
ALL_TUI = Period(profile="tui")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def time_text(column: str | Column) -> Column:
    """Times as text, so that results compare equal whatever the reader does with zones."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def with_time_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: time_text(name) for name in columns})


# --- parsing ---------------------------------------------------------------


@query
def parse_access(spark, sf):
    return with_time_text(parse.parse_access(fx.access_lines(spark, sf), keep=("event_id",)), "ts")


@query
def parse_access_tui(spark, sf):
    rows = parse.parse_access(fx.access_lines(spark, sf), profile="tui", keep=("event_id",))
    return with_time_text(rows, "ts")


@query
def parse_custom_format(spark, sf):
    rows = parse.parse_access(fx.timed_lines(spark, sf), fx.TIMED_FORMAT, keep=("event_id",))
    wanted = ["event_id", "ip_address", "ts", "method", "path", "http_version", "status", "response_size"]
    return with_time_text(rows.select(*wanted, "referrer", "user_agent", "hour"), "ts")


@query
def malformed_lines(spark, sf):
    return parse.malformed_lines(fx.access_lines(spark, sf))


@query
def malformed_count(spark, sf):
    return parse.malformed_lines(fx.access_lines(spark, sf)).agg(F.count("*").alias("n"))


@query
def parse_errors(spark, sf):
    return with_time_text(fx.error_log(spark, sf), "ts")


@query
def parse_errors_tui(spark, sf):
    rows = error_parse.parse_errors(fx.error_lines(spark, sf), "tui", keep=("event_id",))
    return with_time_text(rows.select("event_id", "ts", "level", "pid", "tid", "cid", "message"), "ts")


# --- labels ----------------------------------------------------------------


def _label_query(dimension: str, profile: str) -> Query:
    return lambda spark, sf: counts.label_counts(fx.access_log(spark, sf, profile), dimension, profile)


for _dimension in ("client", "os", "device"):
    for _profile in ("web", "tui"):
        QUERIES[f"ua_{_dimension}_{_profile}"] = _label_query(_dimension, _profile)


@query
def agent_counts(spark, sf):
    return counts.agent_counts(fx.access_log(spark, sf))


@query
def agent_labels(spark, sf):
    """Labels of agents that hit every rule, worked out once an agent."""
    agent = F.col("user_agent")
    by_agent = fx.with_agents(spark, sf).groupBy("user_agent").agg(F.count("*").alias("n"))
    labels = {"client": user_agent.client, "os": user_agent.operating_system, "device": user_agent.device}
    return by_agent.select("user_agent", "n", *[label(agent, profile).alias(f"{name}_{profile}") for profile in ("web", "tui") for name, label in labels.items()])


@query
def bots(spark, sf):
    agent = F.col("user_agent")
    by_agent = fx.access_rows(spark, sf).groupBy("user_agent").agg(F.count("*").alias("n"))
    return by_agent.select(
        "user_agent",
        user_agent.is_bot(agent, "web").alias("bot_web"),
        user_agent.is_bot(agent, "tui").alias("bot_tui"),
        "n",
    )


def _version_query(version: Callable[[Column], Column]) -> Query:
    def run(spark, sf):
        by_path = fx.access_rows(spark, sf).groupBy("path").agg(F.count("*").alias("n"))
        return by_path.select("path", version(F.col("path")).alias("version"), "n")

    return run


QUERIES["api_version_web"] = _version_query(versions.api_version)
QUERIES["api_version_tui"] = _version_query(lambda path: versions.api_version(path, "tui"))
QUERIES["api_version_fast"] = _version_query(versions.api_version_fast)
QUERIES["api_version_candidate"] = _version_query(versions.api_version_candidates)


@query
def version_from_url(spark, sf):
    pages = fx.table(spark, sf, "pages")
    url = F.concat(F.col("url"), F.lit("/api/v"), F.col("page_id") % 12, F.lit("/x"))
    return pages.select(
        "page_id",
        versions.url_path(F.col("url")).alias("path"),
        versions.version_from_url(F.col("url")).alias("version"),
        versions.version_from_url(url).alias("api_version"),
    )


@query
def status_class(spark, sf):
    code = F.col("status")
    return (
        fx.access_log(spark, sf)
        .groupBy(status.status_class(code).alias("status_class"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(status.is_success(code)).alias("success"),
            F.count_if(status.is_redirect(code)).alias("redirect"),
            F.count_if(status.is_client_error(code)).alias("client_error"),
            F.count_if(status.is_server_error(code)).alias("server_error"),
            F.count_if(status.is_error(code)).alias("error"),
        )
    )


@query
def user_requests(spark, sf):
    """Requests per user, by readable identity."""
    pairs = fx.access_log(spark, sf).groupBy("ip_address", "user_agent").agg(F.count("*").alias("n"))
    return pairs.select(text.user_id(F.col("ip_address"), F.col("user_agent")).alias("user_id"), "n")


@query
def byte_labels(spark, sf):
    size = F.col("size")
    return sizes.size_counts(fx.access_log(spark, sf)).select(
        "size",
        formats.format_bytes_rounded(size * 997).alias("rounded"),
        formats.format_bytes(size * 997, 2).alias("decimals"),
        formats.format_bytes_short(size * 997).alias("short"),
        "n",
    )


@query
def count_labels(spark, sf):
    events = fx.table(spark, sf, "events")
    n = F.col("event_id") * 2477
    return events.select(
        "event_id", formats.format_count(n).alias("count_text"), formats.format_uptime(n).alias("uptime_text")
    )


@query
def bands(spark, sf):
    """Levels and bands of the hourly success rate and of the CPU usage of each event."""
    rate = F.col("value") / 330.0
    return fx.table(spark, sf, "events").select(
        "event_id",
        status.rate_level(rate).alias("rate_level"),
        status.rate_band(rate).alias("rate_web"),
        status.rate_band(rate, "tui").alias("rate_tui"),
        status.usage_band(F.col("value")).alias("cpu_web"),
        status.usage_band(F.col("value"), "memory").alias("memory_web"),
        status.usage_band(F.col("value"), "storage").alias("storage_web"),
        status.usage_band(F.col("value"), "cpu", "tui").alias("cpu_tui"),
    )


# --- filters ---------------------------------------------------------------


def _filtered(spark, sf, wanted: LogFilter, settings: Settings = Settings()) -> DataFrame:
    labels = bool(wanted.client or wanted.os or wanted.device_type or settings.exclude_bots)
    kept = wanted.apply(fx.access_log(spark, sf, wanted.period.profile, labels), settings)
    return kept.select("event_id", time_text("ts").alias("ts"), "path", "method", "status")


def _filter_query(wanted: LogFilter, settings: Settings = Settings()) -> Query:
    return lambda spark, sf: _filtered(spark, sf, wanted, settings)


FILTERS = {
    "filter_period_web": (LogFilter(WEEK), Settings()),
    "filter_period_month": (LogFilter(MONTH), Settings()),
    "filter_period_tui": (LogFilter(TUI_WEEK), Settings()),
    "filter_path_method": (LogFilter(path="/api/v1/users", method="POST"), Settings()),
    "filter_status": (LogFilter(status=404), Settings()),
    "filter_status_ranges": (LogFilter(status=((300, 399), (500, 599))), Settings()),
    "filter_ignore_404": (LogFilter(), Settings(ignore_404=True)),
    "filter_exclude_bots": (LogFilter(), Settings(exclude_bots=True)),
    "filter_referrer": (LogFilter(referrer="-"), Settings()),
    "filter_version": (LogFilter(version="v1"), Settings()),
    "filter_version_tui": (LogFilter(Period(profile="tui"), version="v1.1"), Settings()),
    "filter_device": (LogFilter(client="Chrome", os="Android", device_type="Android"), Settings()),
    "filter_hour_weekday": (LogFilter(hour=9, day_of_week=1), Settings()),
    "excluded_endpoints": (
        LogFilter(),
        Settings(ignore_params=True, excluded_endpoints=("/search", "/static/css/app.css")),
    ),
    "filter_conjunction": (
        LogFilter(MONTH, method="GET", status=((200, 299), (400, 499)), version="v1", day_of_week=3),
        Settings(ignore_404=True, exclude_bots=True, excluded_endpoints=("/docs",)),
    ),
}
for _name, (_wanted, _settings) in FILTERS.items():
    QUERIES[_name] = _filter_query(_wanted, _settings)


@query
def excluded_endpoint_table(spark, sf):
    """Excluded paths from a table, here every path of the log that had a server error."""
    log = fx.access_log(spark, sf)
    failing = log.where(F.col("status") == 503).select("path").where("path like '%/api/%'")
    return filters.exclude_endpoints(log, failing).select("event_id", "path")


@query
def filter_endpoint(spark, sf):
    return fx.access_log(spark, sf).where(filters.at_endpoint("/docs", "GET", 200)).select("event_id")


@query
def filter_lookup(spark, sf):
    mobile = filters.by_lookup("user_agent", lambda ua: user_agent.device(ua, "tui"), "Android Phone")
    return fx.access_log(spark, sf).where(mobile).select("event_id")


@query
def filter_location(spark, sf):
    wanted = LogFilter(WEEK, location="NATION_3")
    return wanted.apply(fx.access_log(spark, sf), locations=fx.locations(spark, sf)).select("event_id", "ip_address")


# --- error rows ------------------------------------------------------------


@query
def error_search(spark, sf):
    wanted = ErrorFilter(WEEK, search="LOST the Peer", levels=("error", "crit"))
    return errors.search_errors(fx.error_log(spark, sf), wanted).select("event_id", "level", "message")


@query
def error_severity(spark, sf):
    by_level = errors.severity_counts(fx.error_log(spark, sf))
    return by_level.withColumn("band", status.severity_band(F.col("level")))


@query
def error_sorted(spark, sf):
    ordered = errors.sort_errors(fx.error_log(spark, sf), "client_address", ascending=True)
    return ordered.select("event_id", "client_address", "level")


# --- counts ----------------------------------------------------------------


@query
def endpoint_counts(spark, sf):
    return counts.endpoint_counts(fx.access_log(spark, sf), Settings(ignore_params=True))


@query
def top_endpoints(spark, sf):
    return topk.top_endpoints(counts.endpoint_counts(fx.access_log(spark, sf)))


@query
def top_endpoints_week(spark, sf):
    """From raw lines to the top endpoints of the last week."""
    rows = LogFilter(WEEK).apply(parse.parse_access(fx.access_lines(spark, sf)))
    return topk.top_endpoints(counts.endpoint_counts(rows))


@query
def endpoints_tui(spark, sf):
    return topk.top_endpoints(counts.endpoint_counts(fx.access_log(spark, sf, "tui"), profile="tui"), "tui")


@query
def top_referrers_web(spark, sf):
    return topk.top_referrers(counts.referrer_counts(fx.access_log(spark, sf)))


@query
def top_referrers_tui(spark, sf):
    return topk.top_referrers(counts.referrer_counts(fx.access_log(spark, sf, "tui"), "tui"), "tui")


@query
def version_counts(spark, sf):
    return topk.top_versions(counts.version_counts(fx.access_log(spark, sf)))


@query
def version_counts_tui(spark, sf):
    return topk.top_versions(counts.version_counts(fx.access_log(spark, sf, "tui"), "tui"))


@query
def top_clients(spark, sf):
    return topk.top_labels(counts.label_counts(fx.access_log(spark, sf), "client"), "client", topk.LEGEND_LABELS)


@query
def weekday_counts(spark, sf):
    by_day = counts.weekday_counts(fx.access_log(spark, sf))
    return by_day.withColumn("position", counts.from_monday(F.col("day_of_week")))


@query
def hour_counts(spark, sf):
    by_hour = counts.hour_counts(fx.access_log(spark, sf))
    return by_hour.withColumn("position", counts.from_noon(F.col("hour")))


@query
def time_of_day_15m(spark, sf):
    return counts.time_of_day_counts(fx.access_log(spark, sf), 15)


@query
def time_of_day_3h(spark, sf):
    return counts.time_of_day_counts(fx.access_log(spark, sf), 180)


@query
def share_of_max(spark, sf):
    return topk.share_of_max(topk.top_endpoints(counts.endpoint_counts(fx.access_log(spark, sf))))


@query
def same_method(spark, sf):
    log = fx.access_log(spark, sf)
    listed = topk.top_endpoints(counts.endpoint_counts(log))
    reads = topk.top_endpoints(counts.endpoint_counts(log.where(F.col("method") == "GET")))
    return topk.one_method(listed).select(F.lit("all").alias("list"), "one_method").unionByName(
        topk.one_method(reads).select(F.lit("GET").alias("list"), "one_method")
    )


@query
def dimension_counts(spark, sf):
    return counts.dimension_counts(fx.access_log(spark, sf))


@query
def newest_rows(spark, sf):
    newest = topk.newest_rows(fx.access_log(spark, sf), 500, "event_id")
    return newest.select("event_id", time_text("ts").alias("ts"))


# --- locations -------------------------------------------------------------


@query
def geo_range_join(spark, sf):
    return fx.locations(spark, sf).select("ip_address", "country", "city", "lat", "lon")


@query
def distinct_addresses(spark, sf):
    return geo.distinct_addresses(fx.access_log(spark, sf))


@query
def geo_nested(spark, sf):
    """The longest of nested networks, IPv4 and IPv6, with one that holds every IPv4 address."""
    nation, events = fx.table(spark, sf, "nation"), fx.table(spark, sf, "events")
    networks = geo.networks_from_cidr(spark.sql(fx.over_frames(fx.CIDR_NETWORKS), nation=nation))
    addresses = spark.sql(fx.over_frames(fx.NESTED_ADDRESSES), events=events)
    return geo.resolve(geo.distinct_addresses(addresses), networks).select("ip_address", "country")


@query
def log_with_country(spark, sf):
    placed = geo.with_location(fx.access_log(spark, sf), fx.locations(spark, sf))
    return placed.select("event_id", "ip_address", "country")


@query
def location_counts(spark, sf):
    return topk.top_locations(counts.location_counts(fx.access_log(spark, sf), fx.locations(spark, sf)))


@query
def unknown_ips(spark, sf):
    return geo.unknown_addresses(fx.access_log(spark, sf), fx.locations(spark, sf))


@query
def country_names(spark, sf):
    by_country = counts.location_counts(fx.access_log(spark, sf), fx.locations(spark, sf))
    nation, region = fx.table(spark, sf, "nation"), fx.table(spark, sf, "region")
    names = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("country"), F.concat_ws(", ", "n_name", "r_name").alias("name")
    )
    named = geo.country_names(by_country, names)
    return named.select(
        "country",
        "name",
        text.country_code(F.col("country")).alias("code"),
        text.flag(text.country_code(F.col("country"))).alias("flag"),
        "n",
    )


@query
def live_points(spark, sf):
    places = fx.locations(spark, sf).where("country <> ''").withColumns(
        {"lat": F.length("country").cast("double"), "lon": F.length("ip_address").cast("double")}
    )
    points = geo.live_points(fx.access_log(spark, sf), places, fx.AS_OF, "24 HOURS")
    return with_time_text(points, "ts")


# --- totals ----------------------------------------------------------------

TOTALS = [
    "total_requests", "total_users", "success_count", "success_total", "success_rate", "min_ts", "max_ts",
    "total_hours", "requests_per_hour", "users_per_hour",
]


@query
def totals_and_rates(spark, sf):
    row = totals.totals(fx.access_log(spark, sf)).select(*TOTALS, "first_label", "last_label")
    return with_time_text(row, "min_ts", "max_ts")


@query
def totals_week(spark, sf):
    row = totals.totals(LogFilter(WEEK).apply(fx.access_log(spark, sf)), WEEK).select(*TOTALS)
    return with_time_text(row, "min_ts", "max_ts")


@query
def totals_tui(spark, sf):
    log = LogFilter(TUI_WEEK).apply(fx.access_log(spark, sf, "tui"))
    return with_time_text(totals.totals(log, TUI_WEEK).select(*TOTALS), "min_ts", "max_ts")


@query
def success_rate_web(spark, sf):
    return totals.totals(fx.access_log(spark, sf)).select("success_count", "success_total", "success_rate")


@query
def success_rate_tui(spark, sf):
    row = totals.totals(fx.access_log(spark, sf, "tui"), ALL_TUI)
    return row.select("success_count", "success_total", "success_rate")


@query
def success_percent(spark, sf):
    return totals.success_percent(fx.access_log(spark, sf))


@query
def unique_addresses(spark, sf):
    return totals.address_count(fx.access_log(spark, sf))


@query
def size_stats(spark, sf):
    return sizes.size_stats(fx.access_log(spark, sf))


@query
def size_histogram(spark, sf):
    return sizes.size_histogram(fx.access_log(spark, sf))


# --- series ----------------------------------------------------------------

SERIES = ["bucket", "requests", "users", "success", "total", "rate", "other_requests"]


@query
def activity_buckets(spark, sf):
    log = fx.access_log(spark, sf)
    return with_time_text(activity.activity(LogFilter(WEEK).apply(log), WEEK, log).select(*SERIES), "bucket")


@query
def activity_all_time(spark, sf):
    return with_time_text(activity.activity(fx.access_log(spark, sf)).select(*SERIES), "bucket")


@query
def activity_success(spark, sf):
    log = LogFilter(MONTH).apply(fx.access_log(spark, sf))
    series = activity.activity(log, MONTH).select("bucket", "success", "total", "rate")
    return with_time_text(series.withColumn("level", status.rate_level(F.col("rate"))), "bucket")


@query
def adaptive_buckets(spark, sf):
    log = fx.access_log(spark, sf, "tui")
    return with_time_text(activity.activity(log, ALL_TUI).select(*SERIES), "bucket")


@query
def trend_buckets(spark, sf):
    return with_time_text(activity.trend(fx.access_log(spark, sf)).select(*SERIES), "bucket")


@query
def trend_consolidated(spark, sf):
    return activity.consolidate(activity.trend(fx.access_log(spark, sf)))


@query
def trend_rates_consolidated(spark, sf):
    return activity.consolidate_rates(activity.trend(fx.access_log(spark, sf)))


@query
def bins50_requests(spark, sf):
    return activity.binned_requests(fx.access_log(spark, sf)).select("bin", "requests")


@query
def bins50_users(spark, sf):
    return activity.binned_requests(fx.access_log(spark, sf)).select("bin", "users")


@query
def bins50_success(spark, sf):
    return activity.binned_success(fx.access_log(spark, sf))


@query
def downsample(spark, sf):
    return activity.down_sample(activity.activity(fx.access_log(spark, sf, "tui"), ALL_TUI), 80)


@query
def initial_period_web(spark, sf):
    return initial_period(fx.access_log(spark, sf), fx.AS_OF)


@query
def initial_period_tui(spark, sf):
    return initial_period(fx.access_log(spark, sf), fx.AS_OF, "tui")


# --- export, hosts, report, streams ------------------------------------------


@query
def csv_rows(spark, sf):
    return sinks.csv_rows(LogFilter(MONTH).apply(fx.access_log(spark, sf)))


@query
def host_history(spark, sf):
    history = hosts.host_history(hosts.host_metrics(fx.host_samples(spark, sf)), "tui")
    return with_time_text(history, "ts")


@query
def host_history_web(spark, sf):
    history = hosts.host_history(hosts.host_metrics(fx.host_samples(spark, sf), "web"), "web")
    return with_time_text(history, "ts")


@query
def file_summary(spark, sf):
    return log_files.file_summary(fx.file_catalog(spark, sf))


@query
def files_by_size(spark, sf):
    return log_files.largest_files(fx.file_catalog(spark, sf))


@query
def log_files_read(spark, sf):
    """Lines of access and error logs read back from current, rotated and compressed files."""
    folder = fx.write_log_folder(spark, sf)
    access, error = (files.read_log_dir(spark, folder, kind) for kind in ("access", "error"))
    both = access.unionByName(error)
    kind = F.regexp_replace("source_file", "-[0-9]+", "").alias("kind")
    return both.groupBy(kind).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query
def sorted_by_time(spark, sf):
    return topk.sort_by_time(fx.access_log(spark, sf)).select("event_id", time_text("ts").alias("ts"))


@query
def report_counts(spark, sf):
    parts = report.traffic_report(
        fx.access_log(spark, sf), LogFilter(WEEK), locations=fx.locations(spark, sf)
    )
    return parts["counts"]


@query
def report_totals(spark, sf):
    row = report.traffic_report(fx.access_log(spark, sf), LogFilter(WEEK))["totals"].select(*TOTALS)
    return with_time_text(row, "min_ts", "max_ts")


@query
def report_activity(spark, sf):
    return with_time_text(report.traffic_report(fx.access_log(spark, sf), LogFilter(WEEK))["activity"].select(*SERIES), "bucket")


@query
def report_trend(spark, sf):
    return report.traffic_report(fx.access_log(spark, sf))["trend"]


@query
def report_sizes(spark, sf):
    return report.traffic_report(fx.access_log(spark, sf))["sizes"]


@query
def report_tui_bins(spark, sf):
    return report.traffic_report(fx.access_log(spark, sf, "tui"), LogFilter(ALL_TUI))["bins"].select("bin", "requests")


@query
def lookup_with_duplicates(spark, sf):
    """Of several rows of an address the smallest counts, in lookups and counts alike."""
    places = fx.locations(spark, sf)
    doubled = places.unionByName(places.withColumn("country", F.concat(F.lit("ZZ"), "country")))
    return geo.with_location(fx.access_log(spark, sf), doubled).select("event_id", "ip_address", "country")


@query
def stream_activity(spark, sf):
    return with_time_text(stream_checks.replay_activity(spark, sf), "bucket")


@query
def stream_tail(spark, sf):
    return with_time_text(stream_checks.replay_tail(spark, sf), "bucket")


@query
def stream_closed_windows(spark, sf):
    return with_time_text(stream_checks.replay_closed_windows(spark, sf), "bucket")


@query
def stream_located(spark, sf):
    return with_time_text(stream_checks.replay_located(spark, sf), "ts")


@query
def stream_counts(spark, sf):
    return stream_checks.replay_counts(spark, sf)


@query
def stream_errors(spark, sf):
    return stream_checks.replay_errors(spark, sf)


@query
def stream_rotated(spark, sf):
    return stream_checks.replay_rotated(spark, sf)


@query
def stream_hosts(spark, sf):
    return stream_checks.replay_hosts(spark, sf)


@query
def stream_table(spark, sf):
    return stream_checks.replay_table(spark, sf)


# --- named files, catalogs, layouts without fields --------------------------------


@query
def log_file_read(spark, sf):
    """The lines of one file."""
    return files.read_log_file(spark, f"{fx.write_named_files(spark, sf)}/access-1.log")


@query
def named_files_read(spark, sf):
    """Access and error lines of files given by name."""
    folder = fx.write_named_files(spark, sf)
    access, error = files.read_named_files(spark, [f"{folder}/{name}" for name in ("access-0.log", "error-1.log", "access-2.log")])
    both = access.withColumn("kind", F.lit("access")).unionByName(error.withColumn("kind", F.lit("error")))
    return both.groupBy("kind", "source_file").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query
def log_catalog(spark, sf):
    """Files of a folder that is found through the other kind's path, with their sizes and the summary of all."""
    folder = files.log_location(None, fx.write_named_files(spark, sf))
    catalog = files.log_file_catalog(spark, folder)
    total = log_files.file_summary(catalog).select(F.lit("all").alias("name"), F.col("total_size").alias("size"), F.lit("").alias("extension"))
    return catalog.unionByName(total)


@query
def parse_fallback_format(spark, sf):
    """An empty layout is the default one."""
    rows = parse.parse_access(fx.access_lines(spark, sf), "", keep=("event_id",))
    return with_time_text(rows.select("event_id", "ip_address", "ts", "method", "path", "status", "referrer"), "ts")


@query
def parse_without_address(spark, sf):
    """Rows of a layout without an address: all in web, none in tui."""
    found = [
        parse.parse_access(fx.nameless_lines(spark, sf), fx.NAMELESS_FORMAT, profile).agg(
            F.lit(profile).alias("profile"), F.count("*").alias("n"), F.count_if(F.col("ip_address") == "").alias("nameless")
        )
        for profile in ("web", "tui")
    ]
    return found[0].unionByName(found[1])


@query
def host_samples_read(spark, sf):
    """Every field of host samples read from JSON records."""
    path = f"{stream_checks.work_dir(spark)}/samples"
    fx.host_records(spark, sf).write.json(path)
    rows = read_host_samples(spark, path)
    wide = rows.select("host", "uptime", time_text("timestamp").alias("timestamp"), "cpu.*", "memory.*", F.posexplode("disk").alias("disk_number", "d"))
    return wide.select(
        "host", "uptime", "timestamp", "model", "cores", "speed", "usage", F.get("core_usage", F.lit(0)).alias("core_0"), F.get("core_usage", F.lit(1)).alias("core_1"),
        "free", "available", "used", "total", "disk_number", "d.filesystem", "d.size", F.col("d.used").alias("disk_used"), "d.mounted_on",
    )


@query
def networks_read(spark, sf):
    """Addresses resolved by networks from files: city data, and country data where there is none."""
    folder = stream_checks.work_dir(spark)
    nation = fx.table(spark, sf, "nation")
    text_ = nation.select(F.concat(F.lit("10.0."), "n_nationkey", F.lit(".0/24")).alias("network"), F.col("n_name").alias("country"))
    text_.withColumns({"city": F.lower("country"), "lat": F.lit(1.5), "lon": F.lit(-2.5)}).write.option("header", True).csv(f"{folder}/city")
    text_.write.parquet(f"{folder}/country.parquet")
    addresses = geo.distinct_addresses(fx.access_log(spark, sf))
    by_city = geo.resolve(addresses, read_networks(spark, f"{folder}/city", f"{folder}/country.parquet"))
    by_country = geo.resolve(addresses, read_networks(spark, None, f"{folder}/country.parquet"))
    return by_city.withColumn("source", F.lit("city")).unionByName(by_country.withColumn("source", F.lit("country")))


@query
def report_trend_rates(spark, sf):
    return report.traffic_report(fx.access_log(spark, sf))["trend_rates"]


def _staged_query(part: str) -> Query:
    """A part of the report that reads the rows once."""

    def run(spark, sf):
        week = part in ("counts", "totals", "activity")
        found = report.traffic_report(
            fx.access_log(spark, sf), LogFilter(WEEK) if week else LogFilter(), locations=fx.locations(spark, sf) if part == "counts" else None, staged=True
        )[part]
        if part == "totals":
            return with_time_text(found.select(*TOTALS), "min_ts", "max_ts")
        return with_time_text(found.select(*SERIES), "bucket") if part == "activity" else found

    return run


for _part in ("counts", "totals", "activity", "trend", "trend_rates", "sizes"):
    QUERIES[f"report_{_part}_staged"] = _staged_query(_part)


@query
def report_success_bins(spark, sf):
    return report.traffic_report(fx.access_log(spark, sf, "tui"), LogFilter(ALL_TUI))["success_bins"]


@query
def stream_backfill(spark, sf):
    """Rows by day of a table that got the compressed logs once and follows the plain ones."""
    return stream_checks.replay_backfill(spark, sf)


@query
def stream_late(spark, sf):
    """Closed windows after rows have come days late."""
    return with_time_text(stream_checks.replay_late(spark, sf).closed(), "bucket")


@query
def stream_late_rows(spark, sf):
    """The side output: rows that came for windows already closed."""
    late = stream_checks.replay_late(spark, sf).late_rows()
    return late.select("event_id", time_text("bucket").alias("bucket"))


@query
def stream_restarted(spark, sf):
    return stream_checks.replay_restarted(spark, sf)


@query
def stream_pending(spark, sf):
    return with_time_text(stream_checks.replay_pending(spark, sf), "ts")


@query
def stream_rotation(spark, sf):
    return stream_checks.replay_rotation(spark, sf)


@query
def rollup_filters(spark, sf):
    """The same counts from hourly cells and, for a filter they cannot decide, from the rows."""
    hourly, log = stream_checks.replay_rollup(spark, sf), fx.access_log(spark, sf)
    by_cells = hourly.cells(LogFilter(WEEK, method="GET", status=((200, 299),), version="v1"), Settings(ignore_404=True))
    by_rows = hourly.cells(LogFilter(WEEK, method="GET", referrer="-"), stored=log)
    return by_cells.withColumn("source", F.lit("cells")).unionByName(by_rows.withColumn("source", F.lit("rows"))).select(
        "source", time_text("bucket").alias("bucket"), "method", "path", "status", "n"
    )


@query
def rollup_users(spark, sf):
    """Exact distinct users of each day, and whether the merged sketches are within 3 % of them."""
    estimated = stream_checks.replay_rollup(spark, sf).users(step="day")
    exact = fx.access_log(spark, sf).groupBy(F.date_trunc("day", "ts").alias("bucket")).agg(F.count_distinct("ip_address", "user_agent").alias("exact"))
    close = F.abs(F.col("users") - F.col("exact")) <= F.greatest(F.lit(0.03) * F.col("exact"), F.lit(1))
    return exact.join(estimated, "bucket").select(time_text("bucket").alias("bucket"), "requests", F.col("exact").alias("users"), close.alias("close"))


@query
def rollup_sizes(spark, sf):
    """Whether the merged sketches give each quantile of the sizes within 2 % of all ranks."""
    shares = [0.1, 0.25, 0.5, 0.75, 0.95]
    estimated = stream_checks.replay_rollup(spark, sf).size_quantiles(shares)
    # One row of estimates beside the sizes; each size says for every share on which side it lies.
    asked = estimated.agg(F.sort_array(F.collect_list(F.struct("share", "size"))).alias("asked")).scalar()
    sized = fx.access_log(spark, sf).where("response_size IS NOT NULL").select("response_size", asked.alias("asked"))
    each = sized.select("response_size", F.inline("asked"))
    ranks = each.groupBy("share").agg(
        F.avg((F.col("response_size") < F.col("size")).cast("int")).alias("below"), F.avg((F.col("response_size") <= F.col("size")).cast("int")).alias("upto")
    )
    close = (F.col("below") <= F.col("share") + 0.02) & (F.col("upto") >= F.col("share") - 0.02)
    return ranks.select("share", close.alias("close"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)
