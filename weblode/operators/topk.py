"""Ranked lists. Every limit has a full tie-break, so results do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblode.plans.staging import stage

# --- fixed values -----------------------------------------------------------
TOP_ENDPOINTS = 50
TOP_REFERRERS = {"web": 50, "tui": 16}
TOP_LABELS = 35
LEGEND_LABELS = 10
TOP_LOCATIONS = 12
NEWEST_ROWS = 100_000
# --- end of fixed values ----------------------------------------------------


def top(counts: DataFrame, k: int | None, *ties: str) -> DataFrame:
    """The ``k`` largest by ``n``; ties in ascending order of the given columns.

    Spark keeps k rows per task and merges them (TakeOrderedAndProject).
    """
    ranked = counts.orderBy(F.desc("n"), *[F.asc_nulls_first(name) for name in ties])
    return ranked if k is None else ranked.limit(k)


def top_endpoints(counts: DataFrame, profile: str = "web") -> DataFrame:
    return top(counts, TOP_ENDPOINTS if profile == "web" else None, "path", "method", "status")


def top_referrers(counts: DataFrame, profile: str = "web") -> DataFrame:
    ties = ["referrer"] if profile == "web" else ["referrer", "method", "status"]
    return top(counts, TOP_REFERRERS[profile], *ties)


def top_labels(counts: DataFrame, label: str, k: int = TOP_LABELS) -> DataFrame:
    return top(counts, k, label)


def top_versions(counts: DataFrame, filtered: bool = False, k: int = TOP_LABELS) -> DataFrame:
    """Empty unless there are two versions or a version filter is set."""
    several = counts.agg(F.count("*").alias("n")).scalar() > 1
    return top(counts if filtered else counts.where(several), k, "version")


def top_locations(counts: DataFrame, k: int = TOP_LOCATIONS) -> DataFrame:
    """The busiest countries, each with the number of all countries seen."""
    known = counts.withColumn("locations", F.count("*").over(Window.partitionBy()))
    return top(known, k, "country")


def share_of_max(ranked: DataFrame, count: str = "n") -> DataFrame:
    """Add ``share``, the count over the largest count of a ranked list."""
    return ranked.withColumn("share", F.col(count) / ranked.agg(F.max(count).alias("most")).scalar())


def one_method(ranked: DataFrame) -> DataFrame:
    """Whether every listed endpoint has the same method; false for an empty list."""
    return ranked.agg((F.count_distinct("method") == 1).alias("one_method"))


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in an order, found without gathering them in one task.

    The rows are range-partitioned and kept as a table. Ranges before the ``n``-th row stay
    whole; only the one range it falls into is ranked, so no task sees more rows than a range.
    Fully equal rows are told apart by where they stand, so they spread as well.
    """
    if n <= 0:
        return df.limit(0)
    place, part = "place_in_table", "range_number"
    numbered = df.withColumn(place, F.monotonically_increasing_id())
    keys = [*order, F.asc(place)]
    ranged = numbered.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    ranged = stage(ranged.withColumn(part, F.spark_partition_id()), "ranges")
    sizes = sorted((r[part], r["m"]) for r in ranged.groupBy(part).agg(F.count("*").alias("m")).collect())  # one row a range
    whole, before, edge = [], 0, None
    for number, m in sizes:
        if before + m > n:
            edge = (number, n - before)
            break
        whole.append(number)
        before += m
    kept = ranged.where(F.col(part).isin(whole))
    if edge and edge[1]:
        kept = kept.unionByName(ranged.where(F.col(part) == edge[0]).orderBy(*keys).limit(edge[1]))
    return kept.drop(place, part)


def newest_rows(df: DataFrame, n: int = NEWEST_ROWS, *ties: str) -> DataFrame:
    """The latest rows by time, rows without a time last.

    Counts by hour, then by second of the hour in question, tell which second the ``n``-th row
    falls into. Newer rows stay without being ranked; of that second (or of the rows without a
    time, if there are too few others) the first are taken by ``first_rows``. Equal times are
    ordered by ``ties``, by default all columns that can be ordered.
    """
    ties = ties or tuple(name for name, kind in df.dtypes if name != "ts" and not kind.startswith(("map", "variant")))

    if n <= 0:
        return df.limit(0)

    def edge(rows: DataFrame, unit: str, wanted: int) -> tuple:
        """(first instant of the unit that holds the wanted row from the end, rows after it); (None, all rows) if there are too few."""
        counted = rows.groupBy(F.date_trunc(unit, "ts").alias("at")).agg(F.count("*").alias("m"))
        newer = F.sum("m").over(Window.orderBy(F.desc("at"))) - F.col("m")
        reached = counted.withColumn("newer", newer).where((F.col("newer") < wanted) & (F.col("newer") + F.col("m") >= wanted))
        found = reached.select(F.struct("at", "newer").alias("edge"))
        row = rows.sparkSession.range(1).select(found.scalar().alias("edge"), counted.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("all")).scalar().alias("all")).first()
        return (row["edge"]["at"], row["edge"]["newer"]) if row["edge"] else (None, row["all"])

    dated = df.where(F.col("ts").isNotNull())
    hour, newer = edge(dated, "hour", n)
    if hour is None:
        kept, rest = dated, first_rows(df.where(F.col("ts").isNull()), n - newer, *[F.asc(tie) for tie in ties])
    else:
        within = dated.where((F.col("ts") >= F.lit(hour)) & (F.col("ts") < F.lit(hour) + F.expr("INTERVAL 1 HOUR")))
        second, later = edge(within, "second", n - newer)
        after = F.lit(second) + F.expr("INTERVAL 1 SECOND")
        kept = dated.where(F.col("ts") >= after)
        rest = first_rows(within.where((F.col("ts") >= F.lit(second)) & (F.col("ts") < after)), n - newer - later, F.desc("ts"), *[F.asc(tie) for tie in ties])
    return kept.unionByName(rest).orderBy(F.desc_nulls_last("ts"), *ties)


def sort_by_time(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("ts"))
