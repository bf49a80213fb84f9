"""Periods, their start, and the bucket steps that go with them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
ALL_TIME = "all time"
# Calendar arithmetic; the start itself belongs to the period.
WEB_PERIODS = {
    "1 hour": "INTERVAL 1 HOUR",
    "24 hours": "INTERVAL 24 HOURS",
    "week": "INTERVAL 7 DAYS",
    "month": "INTERVAL 1 MONTH",
    "6 months": "INTERVAL 6 MONTHS",
}
# Hours; the start itself is outside the period.
TUI_PERIODS = {"1 hour": 1, "24 hours": 24, "1 week": 168, "30 days": 720, "6 months": 4320}

# Period -> (activity step, trend step), in seconds.
MINUTE, HOUR, DAY = 60, 3600, 86400
WEB_STEPS = {
    "1 hour": (MINUTE, HOUR),
    "24 hours": (5 * MINUTE, HOUR),
    "week": (HOUR, DAY),
    "month": (6 * HOUR, DAY),
    "6 months": (DAY, DAY),
}
# For all time, by the span of the data: (longest span, activity step, trend step).
WEB_SPAN_STEPS = [(DAY, 5 * MINUTE, HOUR), (7 * DAY, HOUR, DAY), (None, DAY, DAY)]
TUI_STEPS = [5 * MINUTE, 15 * MINUTE, 30 * MINUTE, HOUR, 3 * HOUR, 6 * HOUR, 12 * HOUR, 24 * HOUR]
TUI_MOST_BUCKETS = 1500
WEB_LABELS = {
    "1 hour": ("One hour ago", "Now"),
    "24 hours": ("24 hours ago", "Now"),
    "week": ("One week ago", "Now"),
    "month": ("One month ago", "Now"),
    "6 months": ("Six months ago", "Now"),
}
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Period:
    """A named period that ends at ``as_of``; nothing here reads a clock."""

    name: str = ALL_TIME
    as_of: dt.datetime | None = None
    profile: str = "web"

    def __post_init__(self):
        known = WEB_PERIODS if self.profile == "web" else TUI_PERIODS
        if self.name != ALL_TIME and self.name not in known:
            raise ValueError(f"unknown period {self.name!r}; known: {[*known, ALL_TIME]}")
        if self.name != ALL_TIME and self.as_of is None:
            raise ValueError("a period needs as_of")

    @property
    def bounded(self) -> bool:
        return self.name != ALL_TIME

    def end(self) -> Column:
        return F.lit(self.as_of).cast("timestamp")

    def start(self) -> Column:
        """First instant of the period as a foldable expression, so that it is pushed to the scan."""
        if not self.bounded:
            return F.lit(None).cast("timestamp")
        if self.profile == "web":
            return self.end() - F.expr(WEB_PERIODS[self.name])
        return self.end() - F.expr(f"INTERVAL {TUI_PERIODS[self.name]} HOURS")

    def contains(self, ts: Column) -> Column:
        """web: ``ts >= start``, all rows for all time. tui: ``ts > start``, never null."""
        if self.profile == "web":
            return ts >= self.start() if self.bounded else F.lit(True)
        return ts > self.start() if self.bounded else ts.isNotNull()

    def hours(self) -> Column:
        """Length of a bounded period in hours, at least one."""
        seconds = F.unix_seconds(self.end()) - F.unix_seconds(self.start())
        return F.greatest(seconds / F.lit(3600.0), F.lit(1.0))

    def labels(self) -> tuple[Column, Column]:
        """Texts for the two ends of a time axis; all time shows the data's dates."""
        if self.bounded:
            first, last = WEB_LABELS[self.name]
            return F.lit(first), F.lit(last)
        date = lambda c: F.coalesce(F.date_format(c, "M/d/yyyy"), F.lit(""))
        return date(F.col("min_ts")), date(F.col("max_ts"))


def time_span(df: DataFrame) -> Column:
    """Struct ``(lo, hi)`` of the earliest and latest instant, as a scalar subquery.

    Attach it to a frame as one column; every further mention of the expression would
    be planned as a subquery of its own.
    """
    return df.agg(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi")).alias("span")).scalar()


def _span_seconds(df: DataFrame) -> DataFrame:
    """One row with the ``length`` of the data in seconds, fractions kept."""
    micros = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    return df.agg((micros / F.lit(1_000_000.0)).alias("length"))


def web_steps(period: Period, unfiltered: DataFrame | None = None) -> tuple[Column, Column]:
    """Activity and trend step in seconds; all time goes by the span of all data."""
    if period.bounded:
        activity, trend = WEB_STEPS[period.name]
        return F.lit(activity), F.lit(trend)
    length = F.coalesce("length", F.lit(0.0))
    activity, trend = F.lit(WEB_SPAN_STEPS[-1][1]), F.lit(WEB_SPAN_STEPS[-1][2])
    for longest, step, trend_step in reversed(WEB_SPAN_STEPS[:-1]):
        activity = F.when(length <= longest, step).otherwise(activity)
        trend = F.when(length <= longest, trend_step).otherwise(trend)
    span = _span_seconds(unfiltered)
    return span.select(activity.alias("step")).scalar(), span.select(trend.alias("step")).scalar()


def adaptive_step(length: Column) -> Column:
    """First step that cuts ``length`` seconds into at most 1500 whole buckets, else a day."""
    step = F.lit(TUI_STEPS[-1])
    for candidate in reversed(TUI_STEPS):
        step = F.when(F.floor(length / candidate) <= TUI_MOST_BUCKETS, candidate).otherwise(step)
    return F.when(F.coalesce(length, F.lit(0)) <= 0, TUI_STEPS[0]).otherwise(step)


def tui_step(period: Period, filtered: DataFrame) -> Column:
    if period.bounded:
        return adaptive_step(F.lit(float(TUI_PERIODS[period.name] * 3600)))
    return _span_seconds(filtered).select(adaptive_step(F.col("length")).alias("step")).scalar()


def initial_period(df: DataFrame, as_of: dt.datetime, profile: str = "web") -> DataFrame:
    """The period a fresh view opens with, as one row.

    web: the smallest of 24 hours, week, month and 6 months that holds the latest
    row. tui: the first from 24 hours up that starts before the first row.
    """
    known = WEB_PERIODS if profile == "web" else TUI_PERIODS
    names = [name for name in known if name != "1 hour"]
    edge = F.max("ts") if profile == "web" else F.min("ts")
    choice = F.lit(ALL_TIME)
    for name in reversed(names):
        choice = F.when(Period(name, as_of, profile).contains(F.col("edge")), name).otherwise(choice)
    return df.agg(edge.alias("edge")).select(choice.alias("period"))
