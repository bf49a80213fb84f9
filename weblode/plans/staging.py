"""Write an intermediate result to the cluster's shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from weblode.session import shared_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage at ``df`` through a Parquet table that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
