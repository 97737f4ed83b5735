"""Checks across levels, severities and the roll-up of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How severe a failed level is, and which states fail a run.
SEVERITY = {"L2": "CRITICAL", "L3": "CRITICAL", "L1": "HIGH", "L4": "HIGH", "L5": "HIGH"}
FAILING = ("FAIL", "FAILED", "SKIPPED", "CANCELLED")


def volume_record(volume: DataFrame, records: DataFrame) -> DataFrame:
    """One row: by how much the row counts differ, and what of it is extra less missing,
    rows without a key, and rows of a key beyond those it pairs with on the other side;
    ``explained`` says whether the terms add up."""
    both = volume.join(records, F.lit(True))  # one row each
    out = both.select(
        (F.col("target_total_rows") - F.col("source_total_rows")).alias("volume_difference"),
        (F.col("extra") - F.col("missing")).alias("record_difference"),
        (F.col("unmatchable_target") - F.col("unmatchable_source")).alias("keyless_difference"),
        (F.col("matched_target") - F.col("matched_source")).alias("surplus_difference"),
    )
    return out.withColumn("explained", F.expr("volume_difference = record_difference + keyless_difference + surplus_difference"))


def field_deltas(mismatches: DataFrame) -> DataFrame:
    """source_column, mismatches, numeric, total_delta over all mismatches."""
    return mismatches.groupBy("source_column").agg(F.count(F.lit(1)).alias("mismatches"), F.count("difference").alias("numeric"), F.sum(F.col("difference").cast("decimal(38,6)")).alias("total_delta"))


def field_aggregate(mismatches: DataFrame, checks: DataFrame, rule_columns: dict[str, str]) -> DataFrame:
    """rule, source_column, field_delta, aggregate_difference, explained: does the sum of
    a field's cell differences give the difference of its SUM?"""
    spark = mismatches.sparkSession
    names = spark.createDataFrame(list(rule_columns.items()), "rule string, source_column string")
    deltas = field_deltas(mismatches).select("source_column", F.col("total_delta").alias("field_delta"))
    rows = checks.join(F.broadcast(names), "rule").join(deltas, "source_column", "left")
    out = rows.select("rule", "source_column", F.coalesce(F.col("field_delta").cast("double"), F.lit(0.0)).alias("field_delta"), F.col("difference").alias("aggregate_difference"))
    return out.withColumn("explained", F.abs(F.col("field_delta") - F.col("aggregate_difference")) < 1e-6)


def schema_field(drifts: DataFrame, stats: DataFrame) -> DataFrame:
    """source_column, drift, mismatches: fields that drifted and differ."""
    return drifts.join(stats, drifts["column"] == stats["source_column"]).filter("mismatches > 0").select("source_column", "drift", "mismatches")


def run_rollup(levels: DataFrame) -> DataFrame:
    """One row of (level, status) rows: levels, failed levels, severity, run status."""
    failed = F.col("status").isin(*FAILING)
    weight = F.lit(0)
    for level, name in SEVERITY.items():
        weight = F.when(F.col("level") == level, 3 if name == "CRITICAL" else 2).otherwise(weight)
    row = levels.agg(F.count(F.lit(1)).alias("levels"), F.count_if(failed).alias("failed_levels"), F.max(F.when(failed, F.greatest(weight, F.lit(1))).otherwise(0)).alias("w"))
    severity = F.when(F.col("w") == 3, "CRITICAL").when(F.col("w") == 2, "HIGH").when(F.col("w") == 1, "MEDIUM").otherwise("INFO")
    return row.select("levels", "failed_levels", severity.alias("severity"), F.when(F.col("failed_levels") > 0, "FAIL").otherwise("PASS").alias("status"))
