"""Keyword lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.chars import split_filled, strip
from ..schema import KEYWORD_SET

COMMAS = "[,，]"
UPLOAD_SEPARATORS = "[\\n\\r,;，；]+"


def _first_positions(items: DataFrame) -> DataFrame:
    return (items.groupBy("keyword").agg(F.min("at").alias("at"))
            .select("at", "keyword").orderBy("at"))


def _lines(text: DataFrame, src: int) -> DataFrame:
    """(at, keyword): position is (source, line, place in line)."""
    line = strip(F.col("line"))
    return (text.filter((line != "") & ~line.startswith("#"))
            .select("n", F.posexplode(split_filled(line, COMMAS)).alias("p", "keyword"))
            .select(F.struct(F.lit(src).alias("src"), F.col("n").cast("long").alias("n"),
                             F.col("p").cast("long").alias("p")).alias("at"), "keyword"))


def read_keywords(spark: SparkSession, keywords: Sequence[str] = (), path: str | None = None
                  ) -> DataFrame:
    """Keywords given by hand, then those of a file, each once at its first place."""
    given = spark.createDataFrame([(i, k) for i, k in enumerate(keywords)], "n long, line string")
    items = (given.select("n", F.posexplode(split_filled(F.col("line"), COMMAS)).alias("p", "keyword"))
             .select(F.struct(F.lit(0).alias("src"), F.col("n"), F.col("p").cast("long").alias("p"))
                     .alias("at"), "keyword"))
    if path:
        text = (spark.read.text(path, wholetext=True)
                .select(F.posexplode(F.split("value", "\\r\\n|\\r|\\n")).alias("n", "line")))
        items = items.unionByName(_lines(text, 1))
    return _first_positions(items)


def uploaded_keywords(text: Column) -> Column:
    """Array of keywords of an uploaded text; '#' items dropped, repeats kept."""
    return F.filter(split_filled(text, UPLOAD_SEPARATORS), lambda k: ~k.startswith("#"))


def keywords_in_column(df: DataFrame, text: str, order: str) -> DataFrame:
    """S5 over a text column: every row is one keyword line."""
    lines = df.select(F.col(order).alias("n"), F.col(text).alias("line"))
    return _first_positions(_lines(lines, 1))


def save_keyword_set(spark: SparkSession, path: str, keywords: Sequence[str],
                     filename: str | None = None) -> int:
    """Store a keyword set; returns its size."""
    (spark.createDataFrame([(list(keywords), filename)], KEYWORD_SET)
     .coalesce(1).write.mode("overwrite").json(path))
    return len(keywords)


def load_keyword_set(spark: SparkSession, path: str) -> DataFrame:
    """The stored set; an absent one reads as empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([([], None)], KEYWORD_SET)
    return spark.read.schema(KEYWORD_SET).json(path)
