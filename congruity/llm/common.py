"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Bits of a filter over hashes: 1024 rows of 4 kB, whatever the input, so that it can be
#: broadcast.
FILTER_BITS = 1 << 25
#: Rows of text that a Python worker handles at once.
SLICE = 1000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: this cuts its
    lineage, so that a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what is made of one stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. For ASCII texts that is what lower() does,
    several times faster than translate()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(lowered: Column) -> Column:
    """Maximal runs of digits, a-z and characters beyond ASCII, in order.

    Splitting at the ASCII separators is several times faster in Spark than
    matching the complementary class.
    """
    return F.array_remove(F.split(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def slot(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(FILTER_BITS)) + 1


def filter_of(hashes: DataFrame) -> DataFrame:
    """bucket, bits: the set bits of column ``hash``, at most FILTER_BITS / 32768 rows."""
    at = slot(F.col("hash"))
    return hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def bit_of(bits: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with column ``held``: whether the bit of column ``hash`` is set."""
    at = F.bitmap_bit_position(slot(F.col("hash")))
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(bits), F.bitmap_bucket_number(slot(F.col("hash"))) == F.col("bucket"), "left")
    return joined.select(*rows.columns, F.coalesce(F.bit_get(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias("held"))


def passing(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows whose column ``hash`` has its bit set."""
    return bit_of(bits, rows).filter("held").drop("held")


def failing(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The other rows: what the filter holds is certainly none of them."""
    return bit_of(bits, rows).filter("NOT held").drop("held")
