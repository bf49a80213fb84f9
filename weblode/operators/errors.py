"""Error rows: search, order and counts by severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.operators.filters import ErrorFilter


def search_errors(df: DataFrame, wanted: ErrorFilter) -> DataFrame:
    return wanted.apply(df)


def sort_errors(df: DataFrame, key: str = "ts", ascending: bool = False) -> DataFrame:
    """Sort by any column; missing values come first ascending and last descending."""
    column = F.col(key)
    return df.orderBy(column.asc_nulls_first() if ascending else column.desc_nulls_last())


def severity_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.lower("level").alias("level")).agg(F.count("*").alias("n"))
