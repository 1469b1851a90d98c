"""The stored tables: announcements, cards, mentions.

A state folder holds

* ``announcements``, ``mentions`` and ``contacts``, each ``/batch=N``: rows appended by
  batch N;
* ``urls/batch=N/bucket=B``: the urls of those announcements, dealt by hash;
* ``statistics/batch=N/kind=K``: counts over what batch N has appended;
* ``card_changes/batch=N/bucket=B``: the cards batch N has seen, as card rows, dealt by key;
* ``compact/NAME/batch=N``: what earlier batches have appended, written together now and
  then; announcements lie there by source and month (``by_source=S/by_month=M``);
* ``cards/batch=N/bucket=B``: all cards of a bucket as of batch N, written now and then;
* ``claims/N``: an empty file that the writer of batch N has created;
* ``commits``: one row per finished batch, written last.

A batch number belongs to the state: a writer claims the next free one, which a
file system grants to one writer only. The row of a commit names the writer and
the writer's own batch, so a replay is known by these two, whatever other
writers have stored in between.

Cards are read bucket by bucket: the last one written whole, united with the
changes it does not cover. Uniting cards does not depend on order or grouping, so a
batch writes what it has seen, and rewrites a bucket only once it has gathered some
changes; buckets without changes are never touched.

Readers look only at committed batches: a batch that dies half-way is invisible,
and its number is not used again. Writers that run at once never overwrite each
other, but both may store a url that neither has seen.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.cards import combine_cards
from ..schema import ANNOUNCEMENTS, CARDS, CONTACTS, MENTIONS, STATISTICS

COMMITS = T.StructType([T.StructField("batch", T.LongType()),
                        T.StructField("changed", T.ArrayType(T.IntegerType())),
                        T.StructField("rewritten", T.ArrayType(T.IntegerType())),
                        T.StructField("not_seen", T.ArrayType(T.LongType())),
                        T.StructField("writer", T.StringType()),
                        T.StructField("writer_batch", T.LongType()),
                        T.StructField("compacted", T.ArrayType(T.LongType()))])
KIND = T.StructField("kind", T.StringType())
BUCKET = T.StructField("bucket", T.IntegerType())
LAID_OUT = (T.StructField("by_source", T.StringType()), T.StructField("by_month", T.StringType()))
URLS = T.StructType([T.StructField("url", T.StringType())])
#: Folders of a batch. A large state wants more of them, up to about one for each 128 MB of
#: stored cards or urls; a state keeps the numbers that it was begun with.
CARD_BUCKETS = 32
URL_BUCKETS = 64
#: A bucket of cards is rewritten when so many batches have changed it.
REWRITE_AFTER = 4


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _children(spark: SparkSession, path: str) -> set[str]:
    """Names in a folder: one listing, without going into the folders there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in files.listStatus(p)} if files.exists(p) else set()


def bucket_of(buckets: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Commit:
    """What a finished batch has done to the cards: buckets it changed and those it
    rewrote, and the earlier numbers that were not committed when it looked. A compaction
    names the batches whose rows it has written together."""

    batch: int
    changed: frozenset[int] = frozenset()
    rewritten: frozenset[int] = frozenset()
    not_seen: frozenset[int] = frozenset()
    compacted: frozenset[int] = frozenset()

    def covers(self, batch: int) -> bool:
        return batch <= self.batch and batch not in self.not_seen


@dataclass(frozen=True)
class View:
    """The tables as of some committed batches; none is the empty state."""

    spark: SparkSession
    path: str
    commits: tuple[Commit, ...] = ()
    written: frozenset = frozenset()    # (writer, writer's batch) of what is committed
    url_buckets: int = URL_BUCKETS

    @property
    def batches(self) -> tuple[int, ...]:
        return tuple(c.batch for c in self.commits)

    @property
    def batch(self) -> int:
        return max(self.batches, default=-1)

    @property
    def compaction(self) -> Commit | None:
        """The last compaction; batches it does not name are read from their own folders."""
        return max((c for c in self.commits if c.compacted), key=lambda c: c.batch, default=None)

    def _read(self, folder: str, batches: Iterable[int], schema: T.StructType) -> DataFrame | None:
        there = _children(self.spark, folder)
        paths = [f"{folder}/{name}" for name in (f"batch={n}" for n in sorted(batches)) if name in there]
        return self.spark.read.schema(schema).option("basePath", folder).parquet(*paths) if paths else None

    def _parts(self, name: str, schema: T.StructType, *partitions: T.StructField,
               laid_out: tuple[T.StructField, ...] = ()) -> tuple[DataFrame | None, DataFrame | None]:
        """Rows still in the folders of their batches, and those a compaction has written."""
        last = self.compaction
        wide = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), *partitions])
        loose = self._read(f"{self.path}/{name}", set(self.batches) - (last.compacted if last else set()), wide)
        if last is None:
            return loose, None
        return loose, self._read(f"{self.path}/compact/{name}", [last.batch], T.StructType([*wide.fields, *laid_out]))

    def _united(self, parts: Iterable[DataFrame | None], schema: T.StructType, *partitions: T.StructField) -> DataFrame:
        fields = [*schema.fields, *partitions]
        there = [p.select(*[f.name for f in fields]) for p in parts if p is not None]
        return reduce(DataFrame.unionByName, there) if there else self.spark.createDataFrame([], T.StructType(fields))

    def _appended(self, name: str, schema: T.StructType, *partitions: T.StructField) -> DataFrame:
        return self._united(self._parts(name, schema, *partitions), schema, *partitions)

    def announcements(self, source: str = "", start: date | str | None = None,
                      end: date | str | None = None) -> DataFrame:
        """All announcements, or those of one source and of days between two, both included.

        What a compaction has laid out is read from the folders of that source and those months
        only; rows without a day are in no range.
        """
        loose, laid = self._parts("announcements", ANNOUNCEMENTS, laid_out=LAID_OUT)
        parts = []
        for part in (loose, laid):
            if part is None:
                continue
            if source:
                part = part.filter(F.col("source") == source)
                part = part.filter(F.col("by_source") == source) if "by_source" in part.columns else part
            for day, low in ((start, True), (end, False)):
                if day is None or day == "":
                    continue
                bound = F.lit(str(day)).cast("date")
                part = part.filter(F.col("publish_day") >= bound if low else F.col("publish_day") <= bound)
                if "by_month" in part.columns:
                    month = str(day)[:7]
                    part = part.filter(F.col("by_month") >= month if low else F.col("by_month") <= month)
            parts.append(part)
        return self._united(parts, ANNOUNCEMENTS)

    def mentions(self) -> DataFrame:
        return self._appended("mentions", MENTIONS)

    def contacts(self) -> DataFrame:
        return self._appended("contacts", CONTACTS)

    def urls(self) -> DataFrame:
        """url and bucket of every stored announcement."""
        return self._appended("urls", URLS, BUCKET)

    def known_urls(self, asked: DataFrame) -> DataFrame:
        """Stored urls of the buckets that the asked urls are in; other buckets are not read.

        At most ``url_buckets`` numbers are broadcast. Spark prunes partitions by a side only
        if a comparison says that it may be selective; this one holds for all buckets.
        """
        bucket = bucket_of(self.url_buckets, "url")
        buckets = F.broadcast(asked.filter(bucket >= 0).select(bucket.alias("bucket")).distinct())
        parts = [p.join(buckets, "bucket", "left_semi") for p in self._parts("urls", URLS, BUCKET) if p is not None]
        return self._united(parts, URLS)

    def statistics(self, kind: str) -> DataFrame:
        """(key, count) summed over the states of all batches; see ``plans.statistics``."""
        found = self._appended("statistics", STATISTICS, KIND)
        return (found.filter(F.col("kind") == kind).groupBy("key").agg(F.sum("count").alias("count")))

    def all_statistics(self) -> DataFrame:
        """(key, count, kind) summed over all batches."""
        return (self._appended("statistics", STATISTICS, KIND).groupBy("key", "kind")
                .agg(F.sum("count").alias("count")).select("key", "count", "kind"))

    def _bucketed(self, name: str, where: Iterable[tuple[int, int]]) -> DataFrame:
        schema = T.StructType([*CARDS.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        paths = [f"{self.path}/{name}/batch={n}/bucket={b}" for n, b in sorted(where)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def whole_buckets(self) -> dict[int, Commit]:
        """The last batch that wrote each bucket of cards whole."""
        return {b: c for c in sorted(self.commits, key=lambda c: c.batch) for b in c.rewritten}

    def loose_changes(self) -> dict[int, list[int]]:
        """By bucket, the batches whose changes no whole bucket covers."""
        whole, loose = self.whole_buckets(), {}
        for c in self.commits:
            for b in c.changed:
                if b not in whole or not whole[b].covers(c.batch):
                    loose.setdefault(b, []).append(c.batch)
        return loose

    def cards(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """All cards, or those of some buckets; only buckets with loose changes are regrouped."""
        asked = None if buckets is None else set(buckets)
        whole = {b: c.batch for b, c in self.whole_buckets().items() if asked is None or b in asked}
        loose = {b: ns for b, ns in self.loose_changes().items() if asked is None or b in asked}
        settled = self._bucketed("cards", [(n, b) for b, n in whole.items() if b not in loose])
        if not loose:
            return settled.select(*CARDS.fieldNames())
        moving = self._bucketed("cards", [(n, b) for b, n in whole.items() if b in loose]).unionByName(
            self._bucketed("card_changes", [(n, b) for b, ns in loose.items() for n in ns]))
        return settled.select(*CARDS.fieldNames()).unionByName(combine_cards(moving))


@dataclass(frozen=True)
class State:
    spark: SparkSession
    path: str
    card_buckets: int = CARD_BUCKETS
    url_buckets: int = URL_BUCKETS

    def _card_bucket(self) -> Column:
        return bucket_of(self.card_buckets, "company", "contact_name")

    def view(self) -> View:
        """What is committed now."""
        if not _exists(self.spark, f"{self.path}/commits"):
            return View(self.spark, self.path, url_buckets=self.url_buckets)
        # One short row per batch.
        rows = self.spark.read.schema(COMMITS).json(f"{self.path}/commits").collect()
        commits = tuple(Commit(r.batch, *(frozenset(x or ()) for x in (r.changed, r.rewritten, r.not_seen, r.compacted)))
                        for r in sorted(rows, key=lambda r: r.batch))
        return View(self.spark, self.path, commits,
                    frozenset((r.writer, r.writer_batch) for r in rows if r.writer is not None), self.url_buckets)

    def claim(self) -> int:
        """The next free batch number; no two writers get the same."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        number = 1 + max((int(f.getPath().getName()) for f in files.listStatus(folder)), default=-1)
        while not files.createNewFile(self.spark._jvm.org.apache.hadoop.fs.Path(folder, str(number))):
            number += 1
        return number

    def committed(self) -> int:
        """Number of the last committed batch, -1 when there is none."""
        return self.view().batch

    def announcements(self, source: str = "", start: date | str | None = None,
                      end: date | str | None = None) -> DataFrame:
        return self.view().announcements(source, start, end)

    def mentions(self) -> DataFrame:
        return self.view().mentions()

    def contacts(self) -> DataFrame:
        return self.view().contacts()

    def cards(self) -> DataFrame:
        return self.view().cards()

    def compact(self) -> int | None:
        """Write what all committed batches have appended together, laid out for reading.

        Batches leave small files; this leaves few large ones, and readers list its folders
        instead of those of the batches it covers. Announcements lie by source and month;
        Spark cuts a hot pair into several files and joins small ones. It is a batch like others:
        invisible until it is committed, and a batch that commits meanwhile is not covered and
        stays readable in its own folder. The old folders stay for readers that have already
        looked. Gives its number, or None for an empty state. Cards have their own way, see
        ``add_cards``.
        """
        view = self.view()
        if not view.commits:
            return None
        batch = self.claim()
        month = F.date_format("publish_day", "yyyy-MM")
        a = (view.announcements().withColumn("by_source", F.col("source")).withColumn("by_month", month)
             .hint("rebalance", "by_source", "by_month"))
        for name, df, by in (
                ("announcements", a, ["by_source", "by_month"]),
                ("mentions", view.mentions().hint("rebalance"), []), ("contacts", view.contacts().hint("rebalance"), []),
                ("urls", view.urls().hint("rebalance", "bucket"), ["bucket"]),
                ("statistics", view.all_statistics().hint("rebalance", "kind"), ["kind"])):
            writer = df.write.mode("overwrite")
            (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/compact/{name}/batch={batch}")
        self.commit(batch, Commit(batch, compacted=frozenset(view.batches)))
        return batch

    def append_contacts(self, batch: int, rows: DataFrame) -> None:
        """Stage contact rows (S9), from ``operators.contacts.contact_rows``."""
        self.stage("contacts", batch, rows.select(*CONTACTS.fieldNames()))

    def staged(self, name: str, batch: int, schema: T.StructType) -> DataFrame:
        """Rows a batch has written, committed or not."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={batch}")

    def stage(self, name: str, batch: int, df: DataFrame, by: str | None = None) -> None:
        """Write rows of a batch; ``by`` names a column that deals them into folders, a large one by several tasks."""
        writer = (df if by is None else df.hint("rebalance", by)).write.mode("overwrite")
        (writer if by is None else writer.partitionBy(by)).parquet(f"{self.path}/{name}/batch={batch}")

    def add_urls(self, batch: int, urls: DataFrame) -> None:
        self.stage("urls", batch, urls.select("url", bucket_of(self.url_buckets, "url").alias("bucket")), "bucket")

    def add_cards(self, batch: int, seen: DataFrame, view: View, rewrite_after: int = REWRITE_AFTER) -> Commit:
        """Stage what a batch has seen, and whole the buckets that have gathered enough changes."""
        self.stage("card_changes", batch, combine_cards(seen).withColumn("bucket", self._card_bucket()), "bucket")
        with_bucket = T.StructType([*CARDS.fields, T.StructField("bucket", T.IntegerType())])
        changes = self.staged("card_changes", batch, with_bucket)
        changed = [r.bucket for r in changes.select("bucket").distinct().collect()]  # at most card_buckets
        loose = view.loose_changes()
        rewritten = [b for b in changed if len(loose.get(b, ())) + 1 >= rewrite_after]
        if rewritten:
            whole = combine_cards(view.cards(rewritten).unionByName(
                changes.filter(F.col("bucket").isin(rewritten)).drop("bucket")))
            self.stage("cards", batch, whole.withColumn("bucket", self._card_bucket()), "bucket")
        return Commit(batch, frozenset(changed), frozenset(rewritten),
                      frozenset(range(batch)) - frozenset(view.batches))

    def commit(self, batch: int, cards: Commit | None = None,
               writer: str | None = None, writer_batch: int | None = None) -> None:
        """Make a batch visible: one file, written last."""
        c = cards or Commit(batch)
        row = (batch, sorted(c.changed), sorted(c.rewritten), sorted(c.not_seen) if c.rewritten else [], writer, writer_batch,
               sorted(c.compacted))
        (self.spark.createDataFrame([row], COMMITS).coalesce(1)
         .write.mode("append").json(f"{self.path}/commits"))
