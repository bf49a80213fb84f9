"""Table schemas shared by sources, operators and streams."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names as they appear in host-sample JSON records.
HOST_SAMPLE_JSON = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("uptime", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField(
            "cpu",
            T.StructType(
                [
                    T.StructField("model", T.StringType()),
                    T.StructField("cores", T.IntegerType()),
                    T.StructField("speed", T.DoubleType()),
                    T.StructField("usage", T.DoubleType()),
                    T.StructField("coreUsage", T.ArrayType(T.DoubleType())),
                ]
            ),
        ),
        T.StructField(
            "memory",
            T.StructType(
                [
                    T.StructField("free", T.LongType()),
                    T.StructField("available", T.LongType()),
                    T.StructField("used", T.LongType()),
                    T.StructField("total", T.LongType()),
                ]
            ),
        ),
        T.StructField(
            "disk",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("filesystem", T.StringType()),
                        T.StructField("size", T.LongType()),
                        T.StructField("used", T.LongType()),
                        T.StructField("mountedOn", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
