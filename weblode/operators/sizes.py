"""Response sizes: extremes, exact order statistics and the trimmed histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblode.functions.formats import format_bytes_rounded

# --- fixed values -----------------------------------------------------------
LOW_SHARE, HIGH_SHARE = 0.1, 0.95
MOST_BINS = 500
# --- end of fixed values ----------------------------------------------------

_BLOCK_BITS = 16


def size_counts(df: DataFrame) -> DataFrame:
    """Rows per non-zero response size: ``size, n``."""
    sized = df.where(F.col("response_size").isNotNull() & (F.col("response_size") != 0))
    return sized.groupBy(F.col("response_size").alias("size")).agg(F.count("*").alias("n"))


def size_stats(df: DataFrame) -> DataFrame:
    size = F.nullif(F.col("response_size"), F.lit(0).cast("bigint"))
    return df.agg(F.min(size).alias("size_min"), F.avg(size).alias("size_avg"), F.max(size).alias("size_max"))


def ranked_sizes(counts: DataFrame) -> DataFrame:
    """``size, n, upto, rows``: rows with a size not above this one, and all rows.

    Exact and without one task that sees every size: the running sum is taken
    within blocks of 65,536 neighbouring sizes, over the blocks of a super-block of
    2**32 sizes, and over the super-blocks, of which there are at most 65,536 for
    sizes below 2**48.
    """
    # Never null, or the joins below would infer a filter, push it under the per-size counts and
    # so keep Spark from reusing their shuffle.
    block = F.coalesce(F.shiftright("size", _BLOCK_BITS), F.lit(0).cast("bigint")).alias("block")
    sizes = counts.select("size", "n", block)
    inside = Window.partitionBy("block").orderBy("size")
    sizes = sizes.withColumn("within", F.sum("n").over(inside))

    blocks = counts.groupBy(block).agg(F.sum("n").alias("m"))
    blocks = blocks.withColumn("top", F.shiftright("block", _BLOCK_BITS))
    before_block = F.sum("m").over(Window.partitionBy("top").orderBy("block")) - F.col("m")
    tops = blocks.groupBy("top").agg(F.sum("m").alias("m"))
    before_top = F.sum("m").over(Window.orderBy("top")) - F.col("m")
    tops = tops.select(
        "top", before_top.alias("before_top"), F.sum("m").over(Window.partitionBy()).alias("rows")
    )
    blocks = blocks.select("block", "top", before_block.alias("before_block")).join(tops, "top")
    return sizes.join(blocks, "block").select(
        "size", "n", (F.col("within") + F.col("before_block") + F.col("before_top")).alias("upto"), "rows"
    )


def size_at(position_share: float):
    """Aggregate: the value at index floor(share * rows) of the sorted sizes."""
    index = F.floor(F.col("rows").cast("double") * F.lit(position_share))
    return F.min(F.when(F.col("upto") > index, F.col("size")))


def size_histogram(df: DataFrame) -> DataFrame:
    """``bin, label, n`` over the sizes between the 10 % and the 95 % position.

    One bin per byte up to a range of 500, else 500 equal bins. All parts start
    from the same per-size counts, whose shuffle Spark reuses. Sizes outside the
    bounds go to bin -1 instead of a filter, because a filter would be pushed below
    that aggregation and make the logs be read again.
    """
    return histogram_of(size_counts(df))


def histogram_of(counts: DataFrame) -> DataFrame:
    """``size_histogram`` of ``size, n``."""
    bounds = (
        ranked_sizes(counts)
        .agg(size_at(LOW_SHARE).alias("lo"), size_at(HIGH_SHARE).alias("hi"))
        .select(F.struct("lo", "hi").alias("bounds"))
        .scalar()
    )
    low, high, size = F.col("bounds.lo"), F.col("bounds.hi"), F.col("size")
    reach = high - low
    by_byte = reach <= MOST_BINS
    width = reach / F.lit(float(MOST_BINS))
    wide_bin = F.when(size >= high, MOST_BINS - 1).otherwise(
        F.least(F.floor((size - low) / F.nullif(width, F.lit(0.0))), F.lit(MOST_BINS - 1))
    )
    bin_of = F.when(size.between(low, high), F.when(by_byte, size - low).otherwise(wide_bin)).cast("int")
    binned = counts.withColumn("bounds", bounds).select(
        F.coalesce(bin_of, F.lit(-1)).alias("bin"), "n", F.lit(None).cast("double").alias("start")
    )

    last = F.when(by_byte, reach).otherwise(MOST_BINS - 1).cast("int")
    numbered = counts.sparkSession.range(1).select(bounds.alias("bounds")).select(
        "bounds", F.explode(F.sequence(F.lit(0), last)).alias("bin")
    )
    start = low + F.when(by_byte, F.col("bin").cast("double")).otherwise(F.col("bin") * width)
    slots = numbered.select("bin", F.lit(0).cast("bigint").alias("n"), start.alias("start"))
    filled = binned.unionByName(slots).groupBy("bin").agg(F.sum("n").alias("n"), F.max("start").alias("start"))
    return filled.where("start IS NOT NULL").select("bin", format_bytes_rounded(F.col("start")).alias("label"), "n")
