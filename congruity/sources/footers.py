"""Statistics of Parquet tables from their footers.

Spark answers count, min and max of whole columns from the footers if it reads Parquet
by its second interface and no filter stands between. Both are settings of a session, so
the question is asked in a session of its own; the caller's settings stay as they are.
Nulls are the rows less the count of a column. Text, and types that footers order
otherwise than Spark, have counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col

#: Types whose least and greatest value a footer gives.
ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.BooleanType)
FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true", "spark.sql.parquet.filterPushdown": "true"}


def asking(spark: SparkSession) -> SparkSession:
    own = spark.newSession()
    for k, v in FOOTERS.items():
        own.conf.set(k, v)
    return own


def as_text(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0)  # a footer says -0.0 for a least value of 0.0
    return F.unix_date(c).cast("string") if isinstance(t, T.DateType) else c.cast("string")


def footer_row(spark: SparkSession, path: str) -> DataFrame:
    """One row: n, and for the k-th column c{k} (values that are not null), a{k}, b{k}
    (least and greatest, of the ORDERED types)."""
    df = asking(spark).read.parquet(path)
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, T.AtomicType):
            aggs.append(F.count(col(f.name)).alias(f"c{k}"))
        if isinstance(f.dataType, ORDERED):
            aggs += [F.min(col(f.name)).alias(f"a{k}"), F.max(col(f.name)).alias(f"b{k}")]
    return df.agg(*aggs)


def footer_statistics(spark: SparkSession, path: str) -> DataFrame:
    """column, type, rows, nulls, low, high (as text; dates as days since 1970): a row
    for each column of a Parquet table, without a look at its data. nulls is null for
    nested columns, low and high where footers do not say."""
    row = footer_row(spark, path)
    known, out = set(row.columns), []
    for k, f in enumerate(asking(spark).read.parquet(path).schema.fields):
        nothing = F.lit(None).cast("string")
        low, high = (as_text(F.col(f"{x}{k}"), f.dataType) if f"{x}{k}" in known else nothing for x in "ab")
        nulls = F.col("n") - F.col(f"c{k}") if f"c{k}" in known else F.lit(None).cast("long")
        out.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("rows"), nulls.alias("nulls"), low.alias("low"), high.alias("high")))
    return row.select(F.explode(F.array(*out)).alias("x")).select("x.*")
