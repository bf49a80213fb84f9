"""Scalar figures of a set of log rows, each as a one-row frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.functions.status import SUCCESS_RANGE, succeeded
from weblode.operators.periods import TUI_PERIODS, Period


def user_count(profile: str = "web", approximate: bool = False) -> Column:
    """Distinct (address, user agent) pairs; web counts rows with a time only.

    The exact form is one distinct aggregate, which Spark shuffles by the pair: a
    hot bucket or user is combined before it moves. The approximate form keeps a
    sketch per group.
    """
    address = F.when(F.col("ts").isNotNull(), F.col("ip_address")) if profile == "web" else F.col("ip_address")
    if approximate:
        pair = F.xxhash64("ip_address", "user_agent")
        return F.approx_count_distinct(F.when(address.isNotNull(), pair))
    return F.count_distinct(address, "user_agent")


def success_counts(profile: str = "web", success_range: tuple[int, int] | None = None) -> tuple[Column, Column]:
    """(successes, rows the rate refers to)."""
    good = succeeded(F.col("status"), success_range or SUCCESS_RANGE[profile])
    if profile == "web":
        dated = F.col("ts").isNotNull()
        return F.count_if(dated & good), F.count_if(dated & F.col("status").isNotNull())
    return F.count_if(good), F.count("*")


def hours_in_range(period: Period) -> Column:
    """Hours over which per-hour figures spread, from ``min_ts``, ``max_ts`` and ``total_requests``."""
    seconds = (F.unix_micros("max_ts") - F.unix_micros("min_ts")) / F.lit(1_000_000.0)
    if period.profile == "web":
        fallback = period.hours() if period.bounded else F.lit(1.0)
        return F.when(seconds.isNotNull(), F.greatest(seconds / 3600, F.lit(1.0))).otherwise(fallback)
    whole = F.greatest(F.floor(F.coalesce(seconds, F.lit(0.0)) / 3600).cast("double"), F.lit(1.0))
    if period.bounded:
        return F.when(F.col("total_requests") > 0, F.lit(float(TUI_PERIODS[period.name]))).otherwise(whole)
    return whole


def totals(
    df: DataFrame,
    period: Period = Period(),
    success_range: tuple[int, int] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Requests, users, success, time range, hours and response sizes in one aggregate."""
    profile = period.profile
    success, judged = success_counts(profile, success_range)
    size = F.nullif(F.col("response_size"), F.lit(0).cast("bigint"))
    row = df.agg(
        F.count("*").alias("total_requests"),
        user_count(profile, approximate).alias("total_users"),
        success.alias("success_count"),
        judged.alias("success_total"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        F.min(size).alias("size_min"),
        F.avg(size).alias("size_avg"),
        F.max(size).alias("size_max"),
    )
    return with_rates(row, period)


def with_rates(row: DataFrame, period: Period) -> DataFrame:
    """Rates, hours and labels beside the counted figures."""
    profile = period.profile
    no_rate = F.lit(None).cast("double") if profile == "web" else F.lit(-1.0)
    hours = hours_in_range(period)
    first, last = period.labels() if profile == "web" else Period().labels()
    return row.withColumns(
        {
            "success_rate": F.when(
                F.col("success_total") > 0, F.col("success_count") / F.col("success_total")
            ).otherwise(no_rate),
            "total_hours": hours,
            "requests_per_hour": F.col("total_requests") / hours,
            "users_per_hour": F.col("total_users") / hours,
            "first_label": first,
            "last_label": last,
        }
    )


def address_count(df: DataFrame) -> DataFrame:
    """Distinct non-empty addresses."""
    return df.where(F.col("ip_address") != "").agg(
        F.count_distinct("ip_address").alias("unique_addresses"), F.count("*").alias("total_requests")
    )


def success_percent(df: DataFrame) -> DataFrame:
    """Share of rows with status 200 to 399 among all rows, times 100; 0 without rows."""
    counts = df.agg(
        F.count("*").alias("total_requests"),
        F.count_if(succeeded(F.col("status"), SUCCESS_RANGE["web"])).alias("successful_requests"),
    )
    share = F.try_divide(F.col("successful_requests"), F.col("total_requests")) * 100
    return counts.withColumn("success_rate", F.coalesce(share, F.lit(0.0)))
