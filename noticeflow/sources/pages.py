"""Stored pages in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored pages as (url, html): a parquet table or a folder of page files.

    For page files the file path stands in for the url.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "text":
        return (spark.read.text(path, wholetext=True)
                .select(F.input_file_name().alias("url"), F.col("value").alias("html")))
    if fmt == "binary":
        return (spark.read.format("binaryFile").load(path)
                .select(F.col("path").alias("url"),
                        F.col("content").cast("string").alias("html"),
                        F.col("modificationTime").alias("scraped_at")))
    raise ValueError(f"unknown page format: {fmt}")


def spread(df: DataFrame) -> DataFrame:
    """Give a table of a few large files one partition per core.

    Parsing costs far more than moving the markup once. A table of many files
    already has enough partitions and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
