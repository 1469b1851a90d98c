"""Table schemas. Text columns are '' rather than null once cleaned."""

from __future__ import annotations

from pyspark.sql import types as T

STRING = T.StringType()
STRINGS = T.ArrayType(T.StringType(), False)

PAGES = T.StructType([
    T.StructField("url", STRING),
    T.StructField("html", STRING),
    T.StructField("list_title", STRING),
    T.StructField("list_date", STRING),
    T.StructField("scraped_at", T.TimestampType()),
    T.StructField("ingest_seq", T.LongType()),
])

ANNOUNCEMENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", STRING),
    T.StructField("url", STRING),
    T.StructField("content", STRING),
    T.StructField("publish_date", STRING),
    T.StructField("publish_day", T.DateType()),
    T.StructField("source", STRING),
    T.StructField("scraped_at", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("ingest_seq", T.LongType()),
])

CONTACTS = T.StructType([
    T.StructField("announcement_id", T.LongType()),
    T.StructField("company", STRING),
    T.StructField("contact_name", STRING),
    T.StructField("phone", STRING),
    T.StructField("email", STRING),
])

CARDS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("company", STRING),
    T.StructField("contact_name", STRING),
    T.StructField("phones", T.ArrayType(STRING)),
    T.StructField("emails", T.ArrayType(STRING)),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

MENTIONS = T.StructType([
    T.StructField("business_card_id", T.LongType()),
    T.StructField("announcement_id", T.LongType()),
    T.StructField("role", STRING),
])

STATISTICS = T.StructType([
    T.StructField("key", STRING),
    T.StructField("count", T.LongType()),
])

SEARCH_RESPONSE = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("title", STRING),
        T.StructField("url", STRING),
        T.StructField("publishDate", STRING),
    ]))),
])

KEYWORD_SET = T.StructType([
    T.StructField("keywords", T.ArrayType(STRING)),
    T.StructField("filename", STRING),
])
