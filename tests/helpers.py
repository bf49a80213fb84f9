"""Small frames and plan texts for the tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def lines(spark, *texts: str) -> DataFrame:
    return spark.createDataFrame([(text,) for text in texts], "value string")


def labels_of(spark, function, inputs: list) -> list:
    from pyspark.sql import functions as F

    numbered = spark.createDataFrame(list(enumerate(inputs)), "i int, x string").coalesce(1)
    return [row.y for row in numbered.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def log(spark, rows: list[dict]) -> DataFrame:
    """Access rows with defaults for what a test does not mention."""
    base = dict(
        ip_address="1.1.1.1", ts=at("2024-01-10 08:30:00"), method="GET", path="/", http_version="HTTP/1.1",
        status=200, response_size=100, referrer="-", user_agent="ua",
    )
    schema = (
        "ip_address string, ts timestamp, method string, path string, http_version string, status int, "
        "response_size bigint, referrer string, user_agent string"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple({**base, **row}[name] for name in names) for row in rows], schema)


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().toString()
