"""Corpus pipeline: from raw documents to token ids.

Each stage takes what its predecessor kept, written as Parquet and read again. A
row is known by doc_id with a hash of its text, so null or repeated ids do no
harm; of rows that repeat both, one goes on from the stages that deduplicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from congruity.llm import quality
from congruity.llm.common import failing, filter_of, passing, staged, table
from congruity.llm.decontaminate import decontaminate
from congruity.llm.exact_dedup import exact_dedup, normalised
from congruity.llm.jaccard_join import jaccard_join
from congruity.llm.queries import token_digests


def by_text(text: Column) -> Column:
    return F.struct("doc_id", F.xxhash64(text).alias("text_hash"))


def outside_and_inside(docs: DataFrame, row: Column, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` that are certainly none of ``rows``, and the others with column row.
    Only the latter need a shuffle; the filter between them has a fixed size."""
    bits = staged(filter_of(rows.select(F.xxhash64("row").alias("hash"))))
    named = docs.withColumn("row", row).withColumn("hash", F.xxhash64("row"))
    return failing(named, bits).drop("row", "hash"), passing(named, bits).drop("hash")


def one_of_each(docs: DataFrame, row: Column, found: DataFrame) -> DataFrame:
    """``docs`` without the members of groups that do not stay. ``found`` has row,
    group_size and stays; of rows that repeat, one goes on."""
    found = staged(found.select("row", "group_size", "stays"))
    alone, grouped = outside_and_inside(docs, row, found.filter("group_size > 1"))
    return alone.unionByName(grouped.join(found.filter("stays").select("row"), "row", "left_semi").dropDuplicates(["row"]).drop("row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter(F.col("score") >= quality.THRESHOLD).drop("score")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest id."""
    found = exact_dedup(docs, keep="largest").select(F.struct("doc_id", "text_hash").alias("row"), "group_size", F.col("kept").alias("stays"))
    return one_of_each(docs, by_text(normalised(F.col("text"))), found)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest id."""
    found = jaccard_join(docs).select(F.struct("doc_id", "text_hash").alias("row"), "group_size", "stays")
    return one_of_each(docs, by_text(F.col("text")), found)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = staged(decontaminate(docs, table(spark, sf_dir, "benchmark")).select(F.struct("doc_id", "text_hash").alias("row")))
    clean, suspects = outside_and_inside(docs, by_text(F.col("text")), found)
    return clean.unionByName(suspects.join(found, "row", "left_anti").drop("row"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text."""
    return token_digests(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding and decoding", token_stage),
]

#: SQL cannot express the classifier; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
