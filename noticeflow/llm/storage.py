"""Tables that an operator reads more than once, written to the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from noticeflow.session import shared_dir


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and read it back, so that later steps and retries start from files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
