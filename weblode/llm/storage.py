"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weblode.session import shared_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``stage``, kept in ``buckets`` by ``key``: joins and grouping on it then need no shuffle of this side."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    (
        df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").option("path", path)
        .bucketBy(buckets, key).saveAsTable(table)
    )
    return spark.table(table)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(column: str = "text"):
    """128 bits of a digest as text, equal for equal texts; null counts as empty."""
    return F.left(F.sha2(F.coalesce(F.col(column), F.lit("")), 256), F.lit(32))


def map_texts(df: DataFrame, text_col: str, outputs: str, make: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """Each row of ``df`` as struct ``row``, unchanged and in place, beside the ``outputs`` (a DDL list of columns).

    ``make`` is called once a task; what it returns turns a batch of texts into one list
    for each output. Columns of ``df`` may have any names and types.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    place = df.columns.index(text_col)
    new = StructType.fromDDL(outputs)
    kinds = [(f.name, f.type) for f in to_arrow_schema(new)]
    inner = df.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(batch.column(place).to_pylist())
            columns = [pa.array(values, kind) for values, (_, kind) in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *[n for n, _ in kinds]])

    found = inner.mapInArrow(run, StructType([*inner.schema.fields, *new.fields]))
    return found.select(F.struct(*[F.col(n).alias(c) for n, c in zip(names, df.columns)]).alias("row"), *[f.name for f in new.fields])
