"""Incremental ingest and streaming deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import clean_url
from ..plans.ingest import ingest
from ..schema import PAGES
from ..sources.state import State


def page_stream(spark: SparkSession, path: str, schema: T.StructType = PAGES,
                glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Page files that arrive in a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ingest_stream(pages: DataFrame, state: State, checkpoint: str,
                  available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Every micro-batch runs the batch ingest against the stored snapshot.

    The writer is the progress folder and its batch the micro-batch number, so a
    batch replayed after a lost driver is recognised and not applied twice, and
    other streams and batch runs may write to the same state in between.
    """
    def run(batch: DataFrame, number: int) -> None:
        ingest(batch, state, writer=checkpoint, writer_batch=number)

    writer = pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime=interval))
    return writer.start()


def first_seen(pages: DataFrame, delay: str = "1 day", time: str = "scraped_at",
               spread_by: str | None = None) -> DataFrame:
    """First page per cleaned url within the watermark delay.

    State is bounded by the delay, and so is the answer: a page that arrives
    later than the delay is dropped even if its url is new, and copies further
    apart than the delay both pass. Where neither will do use
    ``first_seen_table``, whose state is never forgotten.

    ``spread_by`` names a column that differs between copies of one url. With
    it copies are first dropped in 64 parts of each url and then overall, so a
    url with a third of all pages keeps 64 tasks busy instead of one, at the
    price of a second, equally long state.
    """
    once = pages.withColumn("url", clean_url(F.col("url"))).withWatermark(time, delay)
    if spread_by:
        part = F.pmod(F.xxhash64(spread_by), F.lit(64))
        once = once.withColumn("_part", part).dropDuplicatesWithinWatermark(["url", "_part"]).drop("_part")
    return once.dropDuplicatesWithinWatermark(["url"])


#: State of any size: on the executors' disks, its changes in the progress folder.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def first_seen_ever(pages: DataFrame, spread_by: str | None = None) -> DataFrame:
    """First page per cleaned url however late it is (T2): a state keyed by url, never forgotten.

    Of copies in one micro-batch any may pass. Start the query with ``STATE_STORE`` set, so
    that the state need not fit in memory. ``spread_by`` as in ``first_seen``.
    """
    once = pages.withColumn("url", clean_url(F.col("url")))
    if spread_by:
        part = F.pmod(F.xxhash64(spread_by), F.lit(64))
        once = once.withColumn("_part", part).dropDuplicates(["url", "_part"]).drop("_part")
    return once.dropDuplicates(["url"])


def first_seen_table(pages: DataFrame, out: str, checkpoint: str, spread_by: str | None = None,
                     available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """``first_seen_ever`` written to ``out``, each url once.

    A micro-batch reads its own pages and the states of their urls; what it has written is
    never read back. The state and the sink's log name the micro-batch, so a replay after
    a lost executor or driver changes nothing.
    """
    spark = pages.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        writer = (first_seen_ever(pages, spread_by).writeStream.format("parquet")
                  .option("checkpointLocation", checkpoint))
        writer = (writer.trigger(availableNow=True) if available_now
                  else writer.trigger(processingTime=interval))
        return writer.start(out)  # a query keeps the settings it was started with
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
