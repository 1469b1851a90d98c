"""Stored responses of a search service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.chars import text_or_empty
from ..schema import SEARCH_RESPONSE

# Fixed value.
RESPONSE_SOURCE = "中国公共资源交易网"


def items_of(responses: DataFrame) -> DataFrame:
    """One row per listed item; missing texts become '' (S4)."""
    return (responses.select(F.explode("data").alias("_d"))
            .select(text_or_empty(F.col("_d.title")).alias("title"),
                    text_or_empty(F.col("_d.url")).alias("url"),
                    text_or_empty(F.col("_d.publishDate")).alias("publish_date"),
                    F.lit(RESPONSE_SOURCE).alias("source")))


def read_search_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON responses; a response without a data list gives no rows."""
    return items_of(spark.read.schema(SEARCH_RESPONSE).option("mode", "PERMISSIVE")
                    .json(path, multiLine=True))


def parse_search_json(df: DataFrame, col: str) -> DataFrame:
    """The same for responses held in a text column."""
    return items_of(df.select(F.from_json(col, SEARCH_RESPONSE).alias("_r")).select("_r.data"))
