"""Driver tables in the roles of the notice tables, in Spark and in SQL.

Each pair below must describe the same rows: the Spark side feeds the
operators, the SQL side feeds the counterpart queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noticeflow.sources.pages import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def announcements(spark: SparkSession, sf: str) -> DataFrame:
    """orders as dated announcements."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("http://notice.example/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.col("o_orderstatus").alias("content"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("publish_date"),
        F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("ingest_seq"))


A = """a AS (SELECT o_orderkey AS id, o_orderpriority AS title,
  'http://notice.example/' || o_orderkey AS url, o_orderstatus AS content,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS publish_date, o_orderstatus AS source,
  o_orderkey AS ingest_seq FROM orders)"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """documents as announcements with content."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("//text.example/"), F.col("lang"), F.lit("/"),
                 F.col("n_chars").cast("string")).alias("url"),
        F.col("text").alias("content"), "source", F.col("doc_id").alias("ingest_seq"))


D = """d AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title,
  '//text.example/' || lang || '/' || n_chars AS url, text AS content, source,
  doc_id AS ingest_seq FROM documents)"""


def cards(spark: SparkSession, sf: str) -> DataFrame:
    """supplier as business cards; some nations stand for placeholder companies."""
    nation = F.col("s_nationkey")
    seen = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s_suppkey") * 60)
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.when(nation == 3, F.lit("详见招标正文")).when(nation == 5, F.lit("AB"))
        .otherwise(F.concat(F.lit("NATION_"), nation.cast("string"))).alias("company"),
        F.col("s_name").alias("contact_name"),
        F.array(F.concat(F.lit("010-"), F.lpad(F.col("s_suppkey").cast("string"), 8, "6")))
        .alias("phones"),
        F.array(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@mail.example")))
        .alias("emails"),
        seen.alias("created_at"),
        F.timestamp_seconds(F.lit(1_700_000_000) + nation.cast("long") * 60).alias("updated_at"))


C = """c AS (SELECT s_suppkey AS id,
  CASE WHEN s_nationkey = 3 THEN '详见招标正文' WHEN s_nationkey = 5 THEN 'AB'
       ELSE 'NATION_' || s_nationkey END AS company,
  s_name AS contact_name, '010-' || lpad(CAST(s_suppkey AS VARCHAR), 8, '6') AS phones,
  's' || s_suppkey || '@mail.example' AS emails,
  1700000000 + s_suppkey * 60 AS created_s, 1700000000 + s_nationkey * 60 AS updated_s
  FROM supplier)"""


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as card mentions."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("business_card_id"), F.col("l_orderkey").alias("announcement_id"),
        F.col("l_returnflag").alias("role"))


M = """m AS (SELECT l_suppkey AS business_card_id, l_orderkey AS announcement_id,
  l_returnflag AS role FROM lineitem)"""


def contacts(spark: SparkSession, sf: str) -> DataFrame:
    """customer as contact rows; one nation has no company name."""
    nation = F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("announcement_id"),
        F.when(nation == 7, F.lit("")).otherwise(
            F.concat(F.lit("NATION_"), nation.cast("string"))).alias("company"),
        F.col("c_mktsegment").alias("contact_name"),
        F.concat(F.lit("138"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone"),
        F.lit("").alias("email"), F.col("c_custkey").alias("ingest_seq"))


K = """k AS (SELECT c_custkey AS announcement_id,
  CASE WHEN c_nationkey = 7 THEN '' ELSE 'NATION_' || c_nationkey END AS company,
  c_mktsegment AS contact_name, '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS phone,
  '' AS email, c_custkey AS ingest_seq FROM customer)"""


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "pages"))


def long_texts(spark: SparkSession, sf: str) -> DataFrame:
    """documents for work that costs much per text."""
    return spread(table(spark, sf, "documents"))


def seconds(col: str) -> Column:
    return F.unix_timestamp(col).alias(col.replace("_at", "_s"))
