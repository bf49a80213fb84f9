"""The traffic report: every aggregate for one filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.functions import user_agent as ua
from weblode.functions.status import SUCCESS_RANGE, succeeded
from weblode.operators import activity, counts, sizes, totals
from weblode.operators.filters import LogFilter, Settings
from weblode.operators.lookup import one_per_key
from weblode.operators.periods import Period, web_steps
from weblode.plans.staging import stage

REPORT_COLUMNS = [
    "ip_address", "ts", "method", "path", "status", "response_size", "referrer", "user_agent",
]


def labelled_counts(by_dimension: DataFrame, locations: DataFrame | None, profile: str) -> DataFrame:
    """Turn user agents into client, os and device, and addresses into locations.

    Works on counted keys in one pass. Addresses without a country appear one by one
    under ``unknown_ip``; the other dimensions pass through.
    """
    key, dimension = F.col("key"), F.col("dimension")
    if locations is None:
        placed = by_dimension.withColumn("country", F.lit(None).cast("string"))
    else:
        known = one_per_key(locations.select("ip_address", "country"), "ip_address").select(
            F.struct(F.lit("ip_address").alias("dimension"), F.col("ip_address").alias("key")).alias("_at"), "country"
        )
        at = F.struct(dimension.alias("dimension"), key.alias("key"))
        placed = by_dimension.withColumn("_at", at).join(known, "_at", "left").drop("_at")

    def entry(name, label):
        return F.struct(name.alias("dimension"), label.alias("key"))

    agent_entries = F.array(
        entry(F.lit("client"), ua.client(key, profile)),
        entry(F.lit("os"), ua.operating_system(key, profile)),
        entry(F.lit("device"), ua.device(key, profile)),
    )
    has_country = F.coalesce(F.col("country"), F.lit("")) != ""
    address_entries = F.array(
        F.when(has_country, entry(F.lit("location"), F.col("country"))).otherwise(entry(F.lit("unknown_ip"), key))
    )
    entries = (
        F.when(dimension == "user_agent", agent_entries)
        .when(dimension == "ip_address", address_entries)
        .otherwise(F.array(entry(dimension, key)))
    )
    return (
        placed.select(F.explode(entries).alias("e"), "method", "status", "n")
        .groupBy(F.col("e.dimension").alias("dimension"), F.col("e.key").alias("key"), "method", "status")
        .agg(F.sum("n").alias("n"))
    )


class Parts(Mapping):
    """Named frames, each built when it is first asked for: building expressions takes longer than many plans run."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


USER, SIZE = "user", "size"


def report_cells(rows: DataFrame, step: Column, settings: Settings, profile: str) -> DataFrame:
    """Partial aggregates for all parts of a report in one pass: ``dimension, key, other, at, method, status`` and figures.

    Each row is expanded to its simple counts, its response size (``at``) and its user
    (``key``, ``other``) in its bucket of ``step`` seconds (``at``, null without a time); equal
    entries are combined before the shuffle.
    """
    none = lambda kind: F.lit(None).cast(kind)

    def entry(dimension: str, key: Column, other: Column, at: Column, detailed: bool = False) -> Column:
        return F.struct(
            F.lit(dimension).alias("dimension"), key.cast("string").alias("key"), other.alias("other"), at.cast("bigint").alias("at"),
            (F.col("method") if detailed else none("string")).alias("method"), (F.col("status") if detailed else none("int")).alias("status"),
        )

    bucket = F.unix_seconds(activity.bucket_start(F.col("ts"), F.col("_step")))
    entries = [entry(name, key, none("string"), none("bigint"), detailed) for name, key, detailed in counts.dimensions(settings, profile)]
    entries.append(entry(USER, F.col("ip_address"), F.col("user_agent"), bucket))
    entries.append(entry(SIZE, none("string"), none("string"), F.nullif("response_size", F.lit(0).cast("bigint"))))
    good = succeeded(F.col("status"), SUCCESS_RANGE[profile])
    spread = rows.withColumn("_step", step).select(F.inline(F.array(*entries)), "ts", good.alias("good"), F.col("status").isNotNull().alias("judged"))
    # The new status column shadows nothing: figures below use ``good`` and ``judged`` of the row.
    return spread.groupBy("dimension", "key", "other", "at", "method", "status").agg(
        F.count("*").alias("n"), F.count_if("good").alias("success"), F.count_if("judged").alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


def series_of(users: DataFrame, step: Column | None = None) -> DataFrame:
    """Bucket counts from the cells of users, at their own step or a coarser one."""
    dated = users.where(F.col("at").isNotNull()).withColumn("bucket", F.timestamp_seconds("at"))
    if step is not None:
        dated = dated.withColumn("_step", step).withColumn("bucket", activity.bucket_start(F.col("bucket"), F.col("_step")))
        dated = dated.groupBy("bucket", "key", "other").agg(*[F.sum(name).alias(name) for name in ("n", "success", "total")])
    known = F.col("key").isNotNull() & F.col("other").isNotNull()
    return dated.groupBy("bucket").agg(
        F.sum("n").alias("requests"), F.count_if(known).alias("users"), F.sum("success").alias("success"), F.sum("total").alias("total")
    )


def totals_of(users: DataFrame, size_counts: DataFrame, period: Period) -> DataFrame:
    """The scalar figures (web) from the cells of users and sizes."""
    dated = F.col("at").isNotNull()
    pairs = users.groupBy("key", "other").agg(
        F.sum("n").alias("n"), F.max(dated).alias("dated"), F.sum(F.when(dated, F.col("success")).otherwise(0)).alias("success"),
        F.sum(F.when(dated, F.col("total")).otherwise(0)).alias("total"), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    known = F.col("dated") & F.col("key").isNotNull() & F.col("other").isNotNull()
    zero = lambda name: F.coalesce(F.sum(name), F.lit(0).cast("bigint"))
    stats = size_counts.agg(
        F.struct(F.min("size").alias("size_min"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("size_avg"), F.max("size").alias("size_max")).alias("stats")
    )
    row = pairs.agg(
        zero("n").alias("total_requests"), F.count_if(known).alias("total_users"), zero("success").alias("success_count"), zero("total").alias("success_total"),
        F.min("first").alias("min_ts"), F.max("last").alias("max_ts"),
    ).withColumn("_stats", stats.scalar())
    row = row.select("*", "_stats.size_min", "_stats.size_avg", "_stats.size_max").drop("_stats")
    return totals.with_rates(row, period)


def traffic_report(
    df: DataFrame,
    wanted: LogFilter = LogFilter(),
    settings: Settings = Settings(),
    locations: DataFrame | None = None,
    staged: bool = False,
    approximate: bool = False,
) -> Parts:
    """All aggregates of the rows that pass the filter, as lazy frames.

    ``staged`` reads the rows once: in web all parts come from one table of partial
    aggregates (``report_cells``) on shared storage, with exact users; in tui, whose 50-bin
    series need single instants, from a table of the filtered columns. Without it every part
    scans the columns it needs; ``counts`` holds every keyed count in long form.
    """
    period, profile = wanted.period, wanted.period.profile
    rows = wanted.apply(df, settings, locations).select(*REPORT_COLUMNS)
    if staged and profile == "web":
        return _one_pass(rows, df, period, settings, locations)
    if staged:
        rows = stage(rows, "report")
    makers = {
        "counts": lambda: labelled_counts(counts.dimension_counts(rows, settings, profile), locations, profile),
        "totals": lambda: totals.totals(rows, period, approximate=approximate),
        "activity": lambda: activity.activity(rows, period, df, approximate=approximate),
        "sizes": lambda: sizes.size_histogram(rows),
    }
    if profile == "web":
        series = Parts({"trend": lambda: activity.trend(rows, period, df, approximate=approximate)})
        makers["trend"] = lambda: activity.consolidate(series["trend"])
        makers["trend_rates"] = lambda: activity.consolidate_rates(series["trend"])
    else:
        makers["bins"] = lambda: activity.binned_requests(rows, approximate=approximate)
        makers["success_bins"] = lambda: activity.binned_success(rows)
    return Parts(makers)


def _one_pass(rows: DataFrame, df: DataFrame, period: Period, settings: Settings, locations: DataFrame | None) -> Parts:
    step, trend_step = web_steps(period, df)
    cells = stage(report_cells(rows, step, settings, "web"), "report")
    users = cells.where(F.col("dimension") == USER)
    size_counts = cells.where((F.col("dimension") == SIZE) & F.col("at").isNotNull()).select(F.col("at").alias("size"), "n")
    simple = cells.where(~F.col("dimension").isin(USER, SIZE)).where(counts.counted_keys("web")).select("dimension", "key", "method", "status", "n")
    instants = users.select(F.explode(F.array("first", "last")).alias("ts"))
    series = Parts({"trend": lambda: activity.with_rates(series_of(users, trend_step), "web")})
    return Parts({
        "counts": lambda: labelled_counts(simple, locations, "web"),
        "totals": lambda: totals_of(users, size_counts, period),
        "activity": lambda: activity.filled_series(series_of(users), instants, step, period),
        "sizes": lambda: sizes.histogram_of(size_counts),
        "trend": lambda: activity.consolidate(series["trend"]),
        "trend_rates": lambda: activity.consolidate_rates(series["trend"]),
    })
