"""Exact deduplication as a log-structured merge index over text digests.

Ingest: every task is a memtable; it flushes runs of digests, sorted, with bloom
filters in their footers. Compaction merges the runs of a level into sorted runs of
the next one: of a digest the smallest identifier stays (or the largest where
asked), and its sizes add up. Digests with more than one member are hits; a filter
over them, of fixed size, picks the texts whose bytes are compared, so that other
texts are never shuffled. All steps are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, filter_of, passing, shared_dir, staged

#: Batches of runs that a level holds before they are merged into the next.
FANOUT = 8
KEEP = {"smallest": F.min, "largest": F.max}


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass
class Index:
    """Runs of (digest, keep_id, group_size, low_hash, high_hash) by level.

    The two hashes are the extremes of a second hash of the members' texts: where
    they differ, the digest stands for different texts.
    """

    spark: SparkSession
    path: str
    keep: str = "smallest"
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=list)

    def flush(self, rows: DataFrame, level: int) -> str:
        """Writes sorted runs with filters, one or more a task, as one batch of a level."""
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        path = f"{self.path}/level={level}/{shared_dir(self.spark).rsplit('-', 1)[-1]}"
        rows.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
        self.levels[level].append(path)
        return path

    def ingest(self, rows: DataFrame) -> DataFrame:
        """Adds a batch of (id, digest, hash) and merges levels that are full; the batch
        as it was written."""
        one = rows.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.col("hash").alias("low_hash"), F.col("hash").alias("high_hash"))
        path = self.flush(one, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self.merge(level)
            level += 1
        return self.spark.read.schema(one.schema).parquet(path).select(F.col("keep_id").alias("id"), "digest", F.col("low_hash").alias("hash"))

    def merged(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*paths).groupBy("digest").agg(KEEP[self.keep]("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.min("low_hash").alias("low_hash"), F.max("high_hash").alias("high_hash"))

    def merge(self, level: int) -> None:
        """All runs of a level into one batch of the next."""
        batches, self.levels[level] = self.levels[level], []
        self.flush(self.merged(batches), level + 1)

    def compact(self) -> DataFrame:
        """Everything as one batch of the last level: a row per digest."""
        batches = [p for level in self.levels for p in level]
        self.levels = [[] for _ in self.levels]
        return self.spark.read.parquet(self.flush(self.merged(batches), len(self.levels)))

    def lookup(self, digest: bytes) -> DataFrame:
        """The entries of one digest in all levels; filters skip the runs without it."""
        return self.spark.read.parquet(*(p for level in self.levels for p in level)).filter(F.col("digest") == F.lit(bytearray(digest)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256, text_hash
    (xxhash64 of the normalised text).

    Texts are equal when identical after lower-casing A-Z; null equals empty.
    Of equal texts one row stays: the one with the smallest (or largest) id. Rows
    that repeat an id with an equal text are members like others, and all of them
    carry kept = true if theirs is the id that stays. A null id stays only in a
    group without any other id. Extra columns are ignored; an empty table gives
    an empty result. Should one ``digest`` ever stand for different bytes, the
    groups of all rows are formed on the texts themselves.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm")).withColumn("hash", F.xxhash64("norm"))
    index = Index(spark, shared_dir(spark), keep)
    members = index.ingest(base.select("id", digest(F.col("norm")).alias("digest"), "hash"))
    level = index.compact()

    # Byte verification. Copies collapse in each task before the shuffle, so a hot group
    # is no burden; a text of another hash passes the filter by chance and does no harm.
    hits = level.filter("group_size > 1")
    bits = staged(filter_of(hits.filter("low_hash = high_hash").select(F.col("low_hash").alias("hash"))))
    texts = passing(base.select("norm", "hash"), bits).groupBy("norm").agg(F.count(F.lit(1)).alias("n"))
    unlike = texts.groupBy(digest(F.col("norm")).alias("digest")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    if unlike.unionByName(hits.filter("low_hash != high_hash").select("digest")).isEmpty():
        found = members.join(level.select("digest", "keep_id", "group_size"), "digest").withColumn("text_sha256", F.lower(F.hex("digest")))
    else:
        by_text = base.groupBy("norm").agg(KEEP[keep]("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = base.join(by_text, "norm").withColumn("text_sha256", F.sha2("norm", 256))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.col("hash").alias("text_hash"))
