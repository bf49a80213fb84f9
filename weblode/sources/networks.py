"""Network tables: CIDR blocks with a location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.operators.geo import networks_from_cidr

NETWORK_COLUMNS = "network string, country string, city string, lat double, lon double"


def read_networks(spark: SparkSession, city_path: str | None, country_path: str | None = None) -> DataFrame:
    """Prefix table from CSV (header) or Parquet; country data is used when there is no city data."""
    path = city_path or country_path
    if path is None:
        raise ValueError("city_path or country_path is needed")
    if path.endswith(".parquet"):
        table = spark.read.parquet(path)
    else:
        table = spark.read.schema(NETWORK_COLUMNS).option("header", True).option("enforceSchema", False).csv(path)
    if city_path is None:
        table = table.select("network", "country", F.lit("").alias("city"))
    return networks_from_cidr(table)
