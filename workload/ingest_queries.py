"""End-to-end ingest, in batches and as a stream."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeflow.plans import statistics
from noticeflow.plans.ingest import ingest as run_ingest
from noticeflow.schema import PAGES
from noticeflow.session import shared_dir
from noticeflow.sources.state import State
from noticeflow.streaming.ingest import first_seen, first_seen_table, ingest_stream, page_stream

from .derived import N
from .derived import notice_pages as derived_notices
from .page_queries import CANDIDATES_SQL
from .registry import query
from .roles import table

NOW = datetime(2024, 2, 1)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares."""
    return f"{shared_dir(spark)}/noticeflow-{name}-{uuid4().hex}"


def _stored(state: State) -> DataFrame:
    """Announcements with the number of their mentions and mentioned cards."""
    m = state.mentions().join(state.cards().select(F.col("id").alias("business_card_id"), "phones"),
                              "business_card_id")
    per_notice = m.groupBy("announcement_id").agg(
        F.count(F.lit(1)).alias("mentions"), F.countDistinct("business_card_id").alias("cards"))
    a = state.announcements()
    return (a.join(per_notice, a["id"] == per_notice["announcement_id"], "left")
            .select("url", "title", "publish_date", F.col("publish_day").cast("string").alias("publish_day"),
                    "source", (F.length("content") > 0).alias("has_text"),
                    F.coalesce("mentions", F.lit(0)).alias("mentions"),
                    F.coalesce("cards", F.lit(0)).alias("cards")))


STORED_SQL = f"""WITH {N}, {CANDIDATES_SQL}, m AS (SELECT page_id, count(DISTINCT (company, contact_name, role)) AS mentions,
  count(DISTINCT (company, contact_name)) AS cards FROM cand WHERE contact_name != '' GROUP BY page_id)
SELECT url, '公告 ' || k AS title, '2024-1-' || n || ' 09:00' AS publish_date,
  CASE WHEN n = '0' THEN NULL ELSE '2024-01-' || lpad(n, 2, '0') END AS publish_day, 'ccgp-bxsearch' AS source,
  has_text, mentions, cards FROM n JOIN m USING (page_id)"""


@query("ingest", STORED_SQL)
def ingest(spark, sf):
    """The pages of one segment first, then all pages: known ones are skipped."""
    pages = derived_notices(spark, sf)
    state = State(spark, _folder(spark, "state"))
    run_ingest(pages.filter(F.col("html").contains("陈明")), state, now=NOW)
    run_ingest(pages, state, now=NOW)
    return _stored(state)


@query("ingest_counters", f"""WITH {N}, {CANDIDATES_SQL}, w AS (SELECT c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD') AS later, count(*) AS card_writes
  FROM cand JOIN customer ON c_custkey = page_id WHERE contact_name != '' AND company != '' GROUP BY later)
SELECT 0 AS batch, count(*) AS pages, count(*) AS new_notices, 0 AS skipped, 0 AS refused,
  (SELECT card_writes FROM w WHERE NOT later) AS card_writes
FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'HOUSEHOLD')
UNION ALL SELECT 1, count(*) + 25, count(*) FILTER (WHERE c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD')),
  count(*) FILTER (WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'HOUSEHOLD')), 25, (SELECT card_writes FROM w WHERE later) FROM customer""")
def ingest_counters(spark, sf):
    """Counters of the same two batches; one refusal page per nation joins the second."""
    pages = derived_notices(spark, sf)
    refusals = table(spark, sf, "nation").select(
        F.lit(-1).cast("long").alias("page_id"),
        F.concat(F.lit("http://refused.example/"), F.col("n_nationkey").cast("string")).alias("url"),
        F.lit("<body>访问过于频繁，请稍后再试</body>").alias("html"),
        (-F.col("n_nationkey").cast("long") - 1).alias("ingest_seq"))
    state = State(spark, _folder(spark, "state"))
    runs = [run_ingest(pages.filter(F.col("html").contains("陈明")), state, now=NOW),
            run_ingest(pages.unionByName(refusals, allowMissingColumns=True), state, now=NOW)]
    return spark.createDataFrame(
        [(i, r.pages, r.new_notices, r.skipped, r.refused, r.card_writes) for i, r in enumerate(runs)],
        "batch long, pages long, new_notices long, skipped long, refused long, card_writes long")


@query("batch_statistics", f"""WITH {N}, {CANDIDATES_SQL}, k AS (SELECT DISTINCT page_id, company, contact_name, role FROM cand
  WHERE contact_name != '' AND company != '')
SELECT 'total' AS kind, 'announcements' AS key, count(*) AS count FROM n
UNION ALL SELECT 'total', 'mentions', count(*) FROM k
UNION ALL SELECT 'source', 'ccgp-bxsearch', count(*) FROM n
UNION ALL SELECT 'day', '2024-1-' || n, count(*) FROM n GROUP BY n
UNION ALL SELECT 'role', role, count(*) FROM k GROUP BY role
UNION ALL SELECT 'company', company, count(DISTINCT page_id) FROM k GROUP BY company
UNION ALL SELECT 'projects', CAST(projects AS VARCHAR), count(*)
  FROM (SELECT count(DISTINCT page_id) AS projects FROM k GROUP BY company, contact_name) GROUP BY projects""")
def batch_statistics(spark, sf):
    """Statistics from the states of two batches, without reading what they have stored."""
    pages = derived_notices(spark, sf)
    state = State(spark, _folder(spark, "state"))
    run_ingest(pages.filter(F.col("html").contains("陈明")), state, now=NOW)
    run_ingest(pages, state, now=NOW)
    view = state.view()
    parts = [view.statistics(k).select(F.lit(k).alias("kind"), "key", "count") for k in ("total", "source", "day", "role", "company")]
    projects = (statistics.with_project_counts(view.cards(), view).groupBy(F.col("projects_count").cast("string").alias("key"))
                .agg(F.count(F.lit(1)).alias("count")).select(F.lit("projects").alias("kind"), "key", "count"))
    return reduce(DataFrame.unionByName, [*parts, projects])


@query("ingest_stream", STORED_SQL)
def ingest_streamed(spark, sf):
    """The same pages arriving as files, one micro-batch per few files."""
    folder, state = _folder(spark, "arriving"), State(spark, _folder(spark, "state"))
    (derived_notices(spark, sf).select(
        "url", "html", F.lit("").alias("list_title"), F.lit("").alias("list_date"),
        F.lit(NOW).alias("scraped_at"), "ingest_seq").repartition(4).write.parquet(folder))
    run = ingest_stream(page_stream(spark, folder, PAGES, files_per_trigger=2), state,
                        _folder(spark, "progress"))
    run.awaitTermination()
    return _stored(state)


@query("ingest_mixed", STORED_SQL)
def ingest_mixed(spark, sf):
    """One state: a batch run, two streams with progress folders of their own, and a replay.

    Every seventh page first arrives as a refusal; its good copy must be stored.
    """
    pages = derived_notices(spark, sf).select(
        "url", "html", F.lit("").alias("list_title"), F.lit("").alias("list_date"),
        F.lit(NOW).alias("scraped_at"), "ingest_seq")
    refusals = (pages.filter(F.col("ingest_seq") % 7 == 0)
                .withColumn("html", F.lit("<body>访问过于频繁，请稍后再试</body>"))
                .withColumn("ingest_seq", F.col("ingest_seq") - 1_000_000_000))
    both, state = pages.union(refusals), State(spark, _folder(spark, "state"))
    part = F.pmod(F.xxhash64("url"), F.lit(3))
    run_ingest(both.filter(part == 0), state, now=NOW)
    for n in (1, 2):
        arriving, progress = _folder(spark, "arriving"), _folder(spark, "progress")
        both.filter(part == n).repartition(2, "url").write.parquet(arriving)
        for _ in range(2):  # the second run finds nothing new
            ingest_stream(page_stream(spark, arriving, PAGES), state, progress).awaitTermination()
    run_ingest(both.filter(part == 1), state, writer="again", writer_batch=0, now=NOW)
    run_ingest(both.filter(part == 1), state, writer="again", writer_batch=0, now=NOW)
    return _stored(state)


@query("stream_dedupe", """SELECT DISTINCT CASE WHEN url LIKE 'https:%' THEN url ELSE 'http:' || substr(url, 6) END AS url
FROM pages""")
def stream_dedupe(spark, sf):
    """Every page arrives twice, once without its scheme; the first one passes."""
    schema = table(spark, sf, "pages").schema
    # A stream takes a single file only by a pattern; this one names the table, a file or a folder of them.
    stream = page_stream(spark, f"{sf}/pages.parque[t]", schema)
    plain = F.regexp_replace("url", "^http:", "")
    twice = (stream.select("page_id", F.explode(F.array("url", plain)).alias("url"))
             .withColumn("scraped_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))))
    out = _folder(spark, "seen")
    run = (first_seen(twice, spread_by="page_id").select("url").writeStream.format("parquet")
           .option("checkpointLocation", _folder(spark, "progress"))
           .trigger(availableNow=True).start(out))
    run.awaitTermination()
    return spark.read.schema("url string").parquet(out)


@query("stream_dedupe_late", """SELECT DISTINCT CASE WHEN url LIKE 'https:%' THEN url
  ELSE 'http:' || substr(url, 6) END AS url, 1 AS n FROM pages""")
def stream_dedupe_late(spark, sf):
    """Copies in later micro-batches carry times years older: none is lost and none passes twice."""
    folder, out = _folder(spark, "arriving"), _folder(spark, "seen")
    pages = table(spark, sf, "pages").select(
        "page_id", F.regexp_replace("url", "^http:", "").alias("url"), F.col("page_id").alias("ingest_seq"))
    for n, rows in enumerate((pages.filter("page_id % 2 = 0"), pages)):
        (rows.withColumn("scraped_at", F.timestamp_seconds(F.lit(1_700_000_000 - n * 100_000_000) + F.col("page_id")))
         .coalesce(2).write.mode("append").parquet(folder))
        stream = page_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
        first_seen_table(stream, out, f"{out}-progress").awaitTermination()
    return spark.read.parquet(out).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
