"""Attach columns of a keyed table to log rows when one key may hold much of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the rows with a key: fewer than 1/share of them, by definition."""
    # The join would infer this filter on one use of the counts only, and their shuffle is used twice.
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    rows = counted.agg(F.sum("_n").alias("rows")).scalar()
    return counted.where(F.col("_n") > rows * share).select(key)


def one_per_key(table: DataFrame, key: str) -> DataFrame:
    """One row per key: the smallest of its rows by the other columns in the table's order."""
    others = [name for name in table.columns if name != key]
    return table.groupBy(key).agg(F.min(F.struct(*others)).alias("_one")).select(key, "_one.*")


def lookup(
    df: DataFrame, table: DataFrame, key: str, columns: list[str], share: float | None = HOT_SHARE, spread: str | None = None
) -> DataFrame:
    """Left join of log rows to a keyed table, safe against hot keys; of several rows of a key one counts (``one_per_key``).

    The values of hot keys, under 1/share rows, are broadcast. Their log rows then
    and those without a key take their own hash as key in the shuffled join, which
    spreads them over all tasks and matches nothing; the rest joins as usual. This costs one pass over the
    key column. ``spread`` names a narrow column whose values differ between rows of a key
    (default: ``ts`` where there is one, else the row's number in its partition).
    ``share=None`` leaves it to adaptive execution.
    """
    values = F.struct(*columns)
    table = one_per_key(table.select(key, *columns), key)
    if share is None:
        return df.join(table.select(key, *columns), key, "left")
    hot = hot_keys(df, key, share).join(table.select(key, values.alias("_hot_value")), key, "left")
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    spread = spread or ("ts" if "ts" in df.columns else None)
    number = F.xxhash64(spread) if spread else F.monotonically_increasing_id()
    own = F.concat(F.lit("\x00"), number.cast("string"))
    keyed = marked.withColumn("_key", F.when(F.col("_hot") | F.col(key).isNull(), own).otherwise(F.col(key)))
    rest = table.select(F.col(key).alias("_key"), values.alias("_value"))
    joined = keyed.join(rest, "_key", "left")
    value = F.coalesce("_hot_value", "_value")
    return joined.select(*df.columns, *[value[name].alias(name) for name in columns])
