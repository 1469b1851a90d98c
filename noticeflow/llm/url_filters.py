"""Dated URL lists and an as-of join of captures with the entries active when they were fetched.

Entries add or remove a pattern at a time; they become validity intervals, cut at the edges of
time buckets. A capture has a few keys, the suffixes of its host and the prefixes of its path,
and meets the intervals by key and bucket: an equi-join, whose row condition is the interval.
A key with very many captures is split by the adaptive skew join; a pattern with very many
entries is ordered bucket by bucket. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 90 * 86_400
FOREVER = "9999-12-31 00:00:00"


def host_of(url: str):
    host = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.regexp_replace(host, r"\.+$", ""))


def path_of(url: str):
    return F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: str):
    """(kind, key): "domain" for each suffix of the host, "prefix" for host/path cut at each slash."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.struct(
        F.lit("prefix").alias("kind"),
        F.concat_ws("/", host, F.array_join(F.slice(parts, 1, i), "/")).alias("key")))
    return (F.when(host == "", F.array().cast("array<struct<kind: string, key: string>>"))
            .when(F.size(parts) > 0, F.concat(domains, prefixes)).otherwise(domains))


def bucket_of(time):
    return F.floor(F.unix_timestamp(time) / BUCKET_SECONDS)


def intervals(entries: DataFrame) -> DataFrame:
    """kind, key, bucket, since, until of entries(kind, pattern, action, listed_at).

    `since` is inside, `until` is not. The action "add" lists a pattern from its time on,
    "remove" unlists it; at one time adding wins. Adding what is listed or removing what is
    not changes nothing, and entries with a null in any of these columns are left out.
    """
    last = F.to_timestamp(F.lit(FOREVER))
    changes = (entries.where(F.col("kind").isNotNull() & F.col("pattern").isNotNull() & F.col("listed_at").isNotNull()
                             & F.col("action").isin("add", "remove"))
               .groupBy("kind", F.col("pattern").alias("key"), F.col("listed_at").alias("since"))
               .agg(F.max(F.col("action") == "add").alias("on"))
               .withColumn("bucket", bucket_of(F.col("since"))))
    # Inside a bucket the next change ends an interval; the last of a bucket is carried on.
    inner = Window.partitionBy("kind", "key", "bucket").orderBy("since")
    cut = changes.withColumn("next", F.lead("since").over(inner))
    closed = cut.where("next is not null and on").select("kind", "key", "bucket", "since", F.col("next").alias("until"))
    outer = Window.partitionBy("kind", "key").orderBy("bucket")
    begins = changes.groupBy("kind", "key", "bucket").agg(F.min("since").alias("first"))
    carried = (cut.where("next is null").select("kind", "key", "bucket", "since", "on")
               .join(begins, ["kind", "key", "bucket"])
               .withColumn("until", F.coalesce(F.lead("first").over(outer), last))
               .where("on").select("kind", "key", "bucket", "since", "until"))
    return closed.union(carried)


def active(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at",
           rules: str = "rules") -> DataFrame:
    """captures with the array `rules` of (kind, key) active at the time of each, most specific first.

    A capture with a null or unparsable url, or a null time, has none. Repeated rows stay; an
    input column named like `rules` is replaced.
    """
    captures = captures.drop(rules)
    spans = intervals(entries)
    last = captures.select(F.max(bucket_of(F.col(fetched_at)))).scalar()
    # An interval is repeated in each bucket it reaches, up to that of the last capture.
    reach = spans.withColumn("bucket", F.explode(F.sequence(
        F.col("bucket"), F.greatest(F.col("bucket"), F.least(
            F.floor((F.unix_timestamp("until") - 1) / BUCKET_SECONDS), last)))))
    # A capture is decided by its url and time alone; equal ones are looked up once.
    asked = (captures.select(F.col(url).alias("_url"), F.col(fetched_at).alias("_at"))
             .where("_url is not null and _at is not null").distinct())
    met = (asked.select("_url", "_at", F.explode(keys_of("_url")).alias("k"))
           .select("_url", "_at", "k.kind", "k.key", bucket_of(F.col("_at")).alias("bucket"))
           .join(reach, ["kind", "key", "bucket"]).where("_at >= since and _at < until")
           .groupBy("_url", "_at")
           .agg(F.collect_set(F.struct(F.length("key").alias("n"), "kind", "key")).alias("found"))
           .select("_url", "_at", F.transform(
               F.sort_array("found", asc=False), lambda r: F.struct(r["kind"].alias("kind"), r["key"].alias("key")))
               .alias(rules)))
    none = F.array().cast("array<struct<kind: string, key: string>>")
    return (captures.join(met, (captures[url] == met["_url"]) & (captures[fetched_at] == met["_at"]), "left")
            .select(*[captures[c] for c in captures.columns], F.coalesce(met[rules], none).alias(rules)))
