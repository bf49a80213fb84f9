"""Hash counts: every function returns keys and ``n``.

Spark aggregates partially before each shuffle, so a key that holds a third of
all rows arrives as one row per task. Labels that depend on the user agent or
the address are attached after a first aggregation by that column, never per
log row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.functions import user_agent as ua
from weblode.functions.versions import api_version
from weblode.operators.filters import Settings
from weblode.operators.lookup import one_per_key


def _rows() -> Column:
    return F.count("*").alias("n")


def _total() -> Column:
    return F.sum("n").alias("n")


def endpoint_counts(df: DataFrame, settings: Settings = Settings(), profile: str = "web") -> DataFrame:
    """Rows per (path, method, status); tui leaves out rows without a status or path."""
    if profile == "tui":
        df = df.where(F.col("status").isNotNull() & (F.col("path") != ""))
    return df.groupBy(settings.counted_path().alias("path"), "method", "status").agg(_rows())


def referrer_counts(df: DataFrame, profile: str = "web") -> DataFrame:
    """Rows per referrer (web) or per (referrer, method, status) (tui)."""
    named = df.where(~F.col("referrer").isin("", "-"))
    if profile == "web":
        return named.groupBy("referrer").agg(_rows())
    return named.where(F.col("status").isNotNull()).groupBy("referrer", "method", "status").agg(_rows())


def version_counts(df: DataFrame, profile: str = "web") -> DataFrame:
    counts = df.groupBy(api_version(F.col("path"), profile).alias("version")).agg(_rows())
    return counts.where(F.col("version") != "")


def agent_counts(df: DataFrame, profile: str = "web") -> DataFrame:
    """Rows per client, system and device in one pass: ``dimension, label, n``.

    The classifiers run once per distinct user agent.
    """
    agent = F.col("user_agent")
    labels = F.inline(
        F.array(
            F.struct(F.lit("client").alias("dimension"), ua.client(agent, profile).alias("label")),
            F.struct(F.lit("os").alias("dimension"), ua.operating_system(agent, profile).alias("label")),
            F.struct(F.lit("device").alias("dimension"), ua.device(agent, profile).alias("label")),
        )
    )
    by_agent = df.groupBy("user_agent").agg(_rows())
    return by_agent.select(labels, "n").groupBy("dimension", "label").agg(_total()).where("label <> ''")


def label_counts(df: DataFrame, dimension: str, profile: str = "web") -> DataFrame:
    """Rows per client, os or device label."""
    label = {"client": ua.client, "os": ua.operating_system, "device": ua.device}[dimension]
    by_agent = df.groupBy("user_agent").agg(_rows())
    counts = by_agent.groupBy(label(F.col("user_agent"), profile).alias(dimension)).agg(_total())
    return counts.where(F.col(dimension) != "")


def _dense(counts: DataFrame, key: str, slots: int) -> DataFrame:
    """Add a zero for each of the slots 0 … slots-1 that has no rows."""
    empty = counts.sparkSession.range(slots).select(
        F.col("id").cast("int").alias(key), F.lit(0).cast("bigint").alias("n")
    )
    return counts.unionByName(empty).groupBy(key).agg(_total())


def weekday_counts(df: DataFrame) -> DataFrame:
    """Seven rows, 0 = Sunday."""
    counts = df.where(F.col("day_of_week").isNotNull()).groupBy("day_of_week").agg(_rows())
    return _dense(counts, "day_of_week", 7)


def hour_counts(df: DataFrame) -> DataFrame:
    counts = df.where(F.col("hour").isNotNull()).groupBy("hour").agg(_rows())
    return _dense(counts, "hour", 24)


def time_of_day_counts(df: DataFrame, minutes: int = 60) -> DataFrame:
    """Rows per slot of the day; ``slot`` is the minute of the day at which it starts."""
    if minutes <= 0 or 1440 % minutes:
        raise ValueError("minutes must divide a day")
    slot = F.floor((F.hour("ts") * 60 + F.minute("ts")) / minutes).cast("int")
    counts = df.where(F.col("ts").isNotNull()).groupBy(slot.alias("slot")).agg(_rows())
    return _dense(counts, "slot", 1440 // minutes).select((F.col("slot") * minutes).alias("slot"), "n")


def from_noon(hour: Column) -> Column:
    """Sort key that starts the day at noon."""
    return (hour + 12) % 24


def from_monday(day_of_week: Column) -> Column:
    """Sort key that starts the week on Monday."""
    return (day_of_week + 6) % 7


def location_counts(df: DataFrame, locations: DataFrame) -> DataFrame:
    """Rows per known country: counted by address first, so the join sees each address once."""
    by_address = df.groupBy("ip_address").agg(_rows())
    known = one_per_key(locations.where(F.col("country") != "").select("ip_address", "country"), "ip_address")
    return by_address.join(known, "ip_address").groupBy("country").agg(_total())


def dimension_counts(
    df: DataFrame, settings: Settings = Settings(), profile: str = "web"
) -> DataFrame:
    """Every simple count in one scan: ``dimension, key, method, status, n``.

    Each row is expanded to one entry per dimension and combined before the
    shuffle; this reads (and parses) the logs once instead of once per card.
    ``user_agent`` and ``ip_address`` entries carry the labels and countries: they
    are classified after the aggregation, by the report.
    """

    entries = [
        F.struct(
            F.lit(dimension).alias("dimension"), key.cast("string").alias("key"), (F.col("method") if detailed else F.lit(None).cast("string")).alias("method"),
            (F.col("status") if detailed else F.lit(None).cast("int")).alias("status"),
        )
        for dimension, key, detailed in dimensions(settings, profile)
    ]
    counts = df.select(F.inline(F.array(*entries))).groupBy("dimension", "key", "method", "status").agg(_rows())
    return counts.where(counted_keys(profile))


def dimensions(settings: Settings, profile: str) -> list[tuple[str, Column, bool]]:
    """(name, key, whether method and status count too) of the simple counts."""
    return [
        ("endpoint", settings.counted_path(), True),
        ("referrer", F.col("referrer"), profile == "tui"),
        ("version", api_version(F.col("path"), profile), False),
        ("user_agent", F.col("user_agent"), False),
        ("ip_address", F.col("ip_address"), False),
        ("hour", F.hour("ts"), False),
        ("day_of_week", F.dayofweek("ts") - 1, False),
    ]


def counted_keys(profile: str) -> Column:
    """Which keys a count shows."""
    kept = F.col("key").isNotNull() & (
        F.col("dimension").isin("user_agent", "ip_address")
        | ((F.col("dimension") == "endpoint") & F.lit(profile == "web"))
        | ((F.col("dimension") == "referrer") & ~F.col("key").isin("", "-"))
        | (~F.col("dimension").isin("referrer") & (F.col("key") != ""))
    )
    if profile == "tui":
        kept = kept & (~F.col("dimension").isin("endpoint", "referrer") | F.col("status").isNotNull())
    return kept
