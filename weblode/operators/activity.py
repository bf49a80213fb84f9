"""Series over time: buckets, zero-fill, trends, 50-bin series and down-sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblode.functions.status import SUCCESS_RANGE, succeeded
from weblode.operators.periods import Period, time_span, tui_step, web_steps
from weblode.operators.totals import user_count

# --- fixed values -----------------------------------------------------------
TREND_POINTS = 6
HISTOGRAM_BINS = 50
SUCCESS_BIN_GRID = 300  # seconds; bounds of the success series are on this grid
NO_DATA = -1.0
# --- end of fixed values ----------------------------------------------------


def bucket_start(ts: Column, step: Column) -> Column:
    """Start of the epoch-aligned bucket of ``step`` seconds that holds ``ts``."""
    seconds = F.unix_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, step))


def bucket_counts(
    df: DataFrame,
    step: Column,
    profile: str = "web",
    success_range: tuple[int, int] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """``bucket, requests, users, success, total`` for the buckets that have rows.

    Users are the only distinct aggregate, so there is no row expansion and the
    shuffle key is (bucket, address, agent): a busy bucket spreads over all tasks.
    """
    good = succeeded(F.col("status"), success_range or SUCCESS_RANGE[profile])
    return (
        df.where(F.col("ts").isNotNull())
        .withColumn("_step", step)
        .groupBy(bucket_start(F.col("ts"), F.col("_step")).alias("bucket"))
        .agg(
            F.count("*").alias("requests"),
            user_count("tui", approximate).alias("users"),
            F.count_if(good).alias("success"),
            F.count("status").alias("total"),
        )
    )


def with_rates(series: DataFrame, profile: str) -> DataFrame:
    none = F.lit(None).cast("double") if profile == "web" else F.lit(NO_DATA)
    rate = F.when(F.col("total") > 0, F.col("success") / F.col("total")).otherwise(none)
    return series.withColumns({"rate": rate, "other_requests": F.col("requests") - F.col("users")})


def zero_fill(series: DataFrame, step: Column, span: Column, clip: bool = False) -> DataFrame:
    """Add a zero row for every empty bucket of ``span``, a struct ``(lo, hi)``, both included.

    ``clip`` drops buckets outside the span. The slots are united with the series and
    summed, which needs no join.
    """
    figures = ["requests", "users", "success", "total"]
    edge = lambda name: F.unix_seconds(bucket_start(F.col(f"_span.{name}"), F.col("_step")))
    slots = (
        series.sparkSession.range(1)
        .select(step.cast("bigint").alias("_step"), span.alias("_span"))
        .select(F.explode(F.sequence(edge("lo"), edge("hi"), F.col("_step"))).alias("_at"))
    )
    empty = slots.select(
        F.timestamp_seconds("_at").alias("bucket"),
        *[F.lit(0).cast("bigint").alias(name) for name in figures],
        F.lit(1).alias("_slot"),
    )
    joined = series.withColumn("_slot", F.lit(0)).unionByName(empty).groupBy("bucket")
    filled = joined.agg(*[F.sum(name).alias(name) for name in figures], F.max("_slot").alias("_slot"))
    return (filled.where("_slot = 1") if clip else filled).drop("_slot")


def activity(
    df: DataFrame,
    period: Period = Period(),
    unfiltered: DataFrame | None = None,
    success_range: tuple[int, int] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """The activity chart: one row per slot of the period, with counts, users and rate.

    The step follows the period; for all time it follows the span of the data
    (``unfiltered`` in web, the rows themselves in tui). The span is a scalar
    subquery over the time column, so nothing runs on the driver.
    """
    profile = period.profile
    if profile == "web":
        step, _ = web_steps(period, unfiltered if unfiltered is not None else df)
    else:
        step = tui_step(period, df)
    return filled_series(bucket_counts(df, step, profile, success_range, approximate), df, step, period)


def filled_series(counts: DataFrame, df: DataFrame, step: Column, period: Period) -> DataFrame:
    """The activity chart from counted buckets; all time spans the rows of ``df`` (its column ``ts``)."""
    profile = period.profile
    fixed = F.struct(period.start().alias("lo"), period.end().alias("hi")) if period.bounded else None
    span = time_span(df) if fixed is None else fixed
    return with_rates(zero_fill(counts, step, span, clip=profile == "tui"), profile)


def trend(
    df: DataFrame,
    period: Period = Period(),
    unfiltered: DataFrame | None = None,
    approximate: bool = False,
) -> DataFrame:
    """The same figures at the coarser trend step, without empty buckets."""
    _, step = web_steps(period, unfiltered if unfiltered is not None else df)
    return with_rates(bucket_counts(df, step, approximate=approximate), "web")


def consolidate(series: DataFrame, points: int = TREND_POINTS) -> DataFrame:
    """Sum a trend into at most ``points`` chunks in time order.

    Users are summed, so they are not distinct across buckets of a chunk. The
    window runs over the aggregated series, a few thousand rows at most.
    """
    whole = Window.partitionBy()
    size = F.ceil(F.count("*").over(whole) / points)
    chunk = F.floor((F.row_number().over(whole.orderBy("bucket")) - 1) / size).cast("int")
    return (
        series.withColumn("chunk", chunk)
        .groupBy("chunk")
        .agg(F.sum("requests").alias("requests"), F.sum("users").alias("users"))
    )


def consolidate_rates(series: DataFrame, points: int = TREND_POINTS) -> DataFrame:
    """Success over total per chunk of the buckets that have a total."""
    whole = Window.partitionBy()
    judged = series.where("total > 0")
    size = F.ceil(F.count("*").over(whole) / points)
    chunk = F.floor((F.row_number().over(whole.orderBy("bucket")) - 1) / size).cast("int")
    sums = (
        judged.withColumn("chunk", chunk)
        .groupBy("chunk")
        .agg(F.sum("success").alias("success"), F.sum("total").alias("total"))
    )
    return sums.withColumn("rate", F.coalesce(F.try_divide("success", "total"), F.lit(0.0)))


def _nanos(ts: Column) -> Column:
    return F.unix_micros(ts) * 1000


def _bin_width(low: Column, high: Column, bins: int) -> Column:
    """Whole nanoseconds per bin, at least one."""
    width = F.call_function("div", _nanos(high) - _nanos(low), F.lit(bins).cast("bigint"))
    return F.greatest(width, F.lit(1).cast("bigint"))


def _bin(ts: Column, low: Column, high: Column, bins: int) -> Column:
    return F.call_function("div", _nanos(ts) - _nanos(low), _bin_width(low, high, bins)).cast("int")


def _all_bins(binned: DataFrame, figures: list[str], bins: int) -> DataFrame:
    empty = binned.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), *[F.lit(0).cast("bigint").alias(name) for name in figures]
    )
    return binned.unionByName(empty).groupBy("bin").agg(*[F.sum(name).alias(name) for name in figures])


def binned_requests(df: DataFrame, bins: int = HISTOGRAM_BINS, approximate: bool = False) -> DataFrame:
    """Rows and distinct users in equal bins from the first to the last instant.

    The last bin takes what lies beyond; a single instant fills bin 0.
    """
    index = F.least(_bin(F.col("ts"), F.col("_span.lo"), F.col("_span.hi"), bins), F.lit(bins - 1))
    binned = (
        df.where(F.col("ts").isNotNull())
        .withColumn("_span", time_span(df))
        .groupBy(index.alias("bin"))
        .agg(F.count("*").alias("requests"), user_count("tui", approximate).alias("users"))
    )
    return _all_bins(binned, ["requests", "users"], bins)


def binned_success(
    df: DataFrame, bins: int = HISTOGRAM_BINS, success_range: tuple[int, int] = SUCCESS_RANGE["tui"]
) -> DataFrame:
    """Success rate in equal half-open bins between the first and last five-minute bucket.

    Rows at or after the end of the last bin fall out; a bin without rows has rate
    0. When there is one bucket only, all bins show its rate.
    """
    judged = df.where(F.col("ts").isNotNull() & F.col("status").isNotNull())
    grid = F.lit(SUCCESS_BIN_GRID)
    ends = judged.agg(
        F.struct(
            bucket_start(F.min("ts"), grid).alias("lo"), bucket_start(F.max("ts"), grid).alias("hi")
        ).alias("span")
    ).scalar()
    one_bucket = F.col("_span.lo") == F.col("_span.hi")
    index = F.when(one_bucket, 0).otherwise(_bin(F.col("ts"), F.col("_span.lo"), F.col("_span.hi"), bins))
    good = succeeded(F.col("status"), success_range)
    binned = (
        judged.withColumn("_span", ends)
        .groupBy(index.alias("bin"))
        .agg(F.count_if(good).alias("success"), F.count("*").alias("total"), F.max(one_bucket).alias("spread"))
    )
    inside = _all_bins(
        binned.where(F.col("bin") < bins).withColumn("spread", F.col("spread").cast("bigint")),
        ["success", "total", "spread"],
        bins,
    )
    # With one bucket the single filled bin stands for all of them.
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    alone = F.first("spread").over(upto) == 1
    shown = inside.select(
        "bin",
        *[F.when(alone, F.first(name).over(upto)).otherwise(F.col(name)).alias(name) for name in ("success", "total")],
    )
    return shown.withColumn("rate", F.coalesce(F.try_divide("success", "total"), F.lit(0.0)))


def down_sample(series: DataFrame, columns: int) -> DataFrame:
    """Fit a series into ``columns`` chart columns.

    A column shows the busiest of its points (the first one on ties) with the users
    of that point, and the mean of the rates that have data (-1 for none). With
    fewer points than columns a point is repeated. ``series`` is an aggregated
    series: the point number comes from a window over it.
    """
    order = Window.partitionBy().orderBy("bucket")
    points = series.select(
        (F.row_number().over(order) - 1).cast("bigint").alias("point"),
        F.count("*").over(Window.partitionBy()).alias("points"),
        "requests",
        "users",
        F.when(F.col("rate") >= 0, F.col("rate")).alias("rate"),
    )
    div = lambda a, b: F.call_function("div", a, b)
    point, count, width = F.col("point"), F.col("points"), F.lit(columns).cast("bigint")
    # Column i covers the points from floor(i*n/N) to before floor((i+1)*n/N), or just the
    # first of them if that is empty. Solved for i: with n >= N point j has one column, with
    # n < N it fills the columns from ceil(j*N/n) to ceil((j+1)*N/n) - 1.
    crowded = count >= width
    last = div((point + 1) * width + count - 1, count) - 1
    first_repeat = div(point * width + count - 1, count)
    first = F.when(crowded, last).otherwise(first_repeat)
    placed = points.select(
        F.explode(F.sequence(first, last)).alias("column"),
        "point",
        "requests",
        "users",
        "rate",
    )
    busiest = F.max(F.struct(F.col("requests"), (-F.col("point")).alias("rank"), F.col("users")))
    return (
        placed.groupBy(F.col("column").cast("int").alias("column"))
        .agg(busiest.alias("top"), F.avg("rate").alias("rate"))
        .select(
            "column",
            F.col("top.requests").alias("requests"),
            F.when(F.col("top.requests") > 0, F.col("top.users")).otherwise(0).alias("users"),
            F.coalesce("rate", F.lit(NO_DATA)).alias("rate"),
        )
    )
