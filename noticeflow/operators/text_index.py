"""A stored index for substring search, so that a search reads a part of the texts only.

An index folder holds, each below ``batch=N``:

* ``texts/block=B``: the rows as given, dealt over ``blocks`` by their id;
* ``postings/bucket=K``: (gram, id, block) in the order of grams, dealt by gram;
* ``counts/bucket=K``: (gram, texts), how many rows of the batch hold a gram.

A search cuts its text into grams of three characters, looks up in ``counts`` which of them
are rarest, reads the postings of those few (partition and row-group filters, as grams are
sorted), and then the blocks that hold a candidate (dynamic partition pruning). What
is read is compared with the pattern itself, so the rows are those of a scan. A batch is
added without reading what is stored; one that is added again replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.chars import like_text
from .grams import gram_numbers, grams, literal_parts, text_counts

GRAM = 3
#: So many of the rarest grams of a search text are looked up.
LOOKED_UP = 4
#: Into so many files a bucket of postings is split; those of one gram lie in one file.
FILES = 8


def text_of(columns: Sequence[str]) -> Column:
    """The searched columns in lower case, apart from each other."""
    return F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    id: str = "id"
    blocks: int = 256
    buckets: int = 64

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(gram, F.lit(self.buckets)).cast("int")

    def _block(self) -> Column:
        return F.pmod(F.xxhash64(self.id), F.lit(self.blocks)).cast("int")

    def add(self, rows: DataFrame, batch: int = 0) -> None:
        """Store rows and their postings; null columns are empty, ids are unique."""
        rows = rows.withColumn("block", self._block())
        rows.repartition("block").sortWithinPartitions("block", self.id).write.mode("overwrite").partitionBy(
            "block").parquet(f"{self.path}/texts/batch={batch}")
        stored = (self.spark.read.schema(T.StructType([f for f in rows.schema if f.name != "block"]))
                  .parquet(f"{self.path}/texts/batch={batch}"))
        found = (grams(stored.withColumn("_text", text_of(self.columns)), self.id, "_text", GRAM)
                 .select("gram", F.col("key").alias(self.id)))
        # Dealt by hash: ranges would be sampled first, and the grams of all texts made twice for it.
        part = F.pmod(F.xxhash64("gram"), F.lit(FILES))
        (found.withColumn("block", self._block()).withColumn("bucket", self._bucket(F.col("gram")))
         .repartition("bucket", part).sortWithinPartitions("bucket", "gram")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}"))
        counts = text_counts(self._read("postings", rows.schema[self.id].dataType).filter(F.col("batch") == batch))
        (counts.withColumn("bucket", self._bucket(F.col("gram")))
         .repartition("bucket").sortWithinPartitions("bucket", "gram")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts/batch={batch}"))

    def _read(self, name: str, id_type: T.DataType | None = None) -> DataFrame:
        own = ([T.StructField(self.id, id_type), T.StructField("block", T.IntegerType())] if name == "postings"
               else [T.StructField("texts", T.LongType())])
        schema = T.StructType([T.StructField("gram", T.LongType()), *own, T.StructField("batch", T.LongType()),
                               T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def texts(self) -> DataFrame:
        """All stored rows, with the partition columns batch and block."""
        return self.spark.read.parquet(f"{self.path}/texts")

    def pattern(self, q: str) -> Column:
        found = [like_text(F.col(c), q) for c in self.columns]
        where = found[0]
        for f in found[1:]:
            where = where | f
        return where

    def rarest(self, q: str, most: int = LOOKED_UP) -> list[int] | None:
        """The rarest grams of a search text; None if it is too short for any, [] if no text has one of them.

        A small job: at most as many stored counts are read as the text has characters.
        """
        asked = sorted({g for part in literal_parts(q.lower()) for g in gram_numbers(part, GRAM)})
        if not asked:
            return None
        rows = (self._read("counts").filter(F.col("bucket").isin(sorted({g % self.buckets for g in asked})) & F.col("gram").isin(asked))
                .groupBy("gram").agg(F.sum("texts").alias("texts")).collect())
        if len(rows) < len(asked):
            return []
        return [r.gram for r in sorted(rows, key=lambda r: (r.texts, r.gram))[:most]]

    def candidates(self, q: str) -> DataFrame | None:
        """(id, block) of the rows that hold the rarest grams; None if the text is too short for any."""
        rare = self.rarest(q)
        if rare is None:
            return None
        id_type = self.texts().schema[self.id].dataType
        found = self._read("postings", id_type).filter(F.col("bucket").isin(sorted({g % self.buckets for g in rare})) & F.col("gram").isin(rare))
        return (found.groupBy(self.id, "block").agg(F.countDistinct("gram").alias("n"))
                .filter(F.col("n") == len(rare)).select(self.id, "block"))

    def search(self, q: str) -> DataFrame:
        """Stored rows whose columns match the search text; '' is no filter, wildcards as in ``like_text``."""
        rows = self.texts()
        found = self.candidates(q) if q else None
        if found is not None:
            blocks = F.broadcast(found.select("block").distinct())  # at most ``blocks`` rows
            rows = rows.join(blocks, "block", "left_semi").join(found.select(self.id), self.id, "left_semi")
        if q:
            rows = rows.filter(self.pattern(q))
        return rows.drop("block", "batch")
