"""Level 2: rows, keys and nulls, in one aggregate a side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, percent_change, rate_pct, usable
from ..spec import ReconSpec


def key_struct(keys: list[str]) -> Column:
    return F.struct(*(col(k).alias(f"k{i}") for i, k in enumerate(keys)))


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: total_rows, keyed_rows, distinct_keys, duplicate_rows (rows beyond the
    first of a key), unusable_rows."""
    ok = usable(keys)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(ok).alias("keyed_rows"),
        F.count_distinct(F.when(ok, key_struct(keys))).alias("distinct_keys"),
    ).withColumns({"duplicate_rows": F.col("keyed_rows") - F.col("distinct_keys"), "unusable_rows": F.col("total_rows") - F.col("keyed_rows")})


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, nulls: counted in one pass, then turned to rows."""
    row = df.agg(*(F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(columns)))).alias("x")).select("x.*")


def mapped_null_counts(source: DataFrame, target: DataFrame, spec: ReconSpec) -> DataFrame:
    """column, target_column, source_nulls, target_nulls, matched for columns on both sides."""
    pairs = [(s, t) for s, t in [*spec.keys, *((m.source, m.target) for m in spec.pairs(source.columns, target.columns))]]
    s, t = null_counts(source, [p for p, _ in pairs]), null_counts(target, [p for _, p in pairs])
    names = source.sparkSession.createDataFrame(pairs, "column string, target_column string")
    out = names.join(s.withColumnRenamed("nulls", "source_nulls"), "column").join(t.select(F.col("column").alias("target_column"), F.col("nulls").alias("target_nulls")), "target_column")
    return out.select("column", "target_column", "source_nulls", "target_nulls", (F.col("source_nulls") == F.col("target_nulls")).alias("matched"))


def volume_checks(source: DataFrame, target: DataFrame, spec: ReconSpec) -> DataFrame:
    """check, source, target, difference, percentage_difference, matched, a row a check."""
    keys = [s for s, _ in spec.keys], [t for _, t in spec.keys]
    names = ("total_rows", "distinct_keys", "duplicate_rows") if spec.keys else ("total_rows",)

    def side(df: DataFrame, k: list[str], out: str) -> DataFrame:
        row = key_counts(df, k) if k else df.agg(F.count(F.lit(1)).alias("total_rows"))
        return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias(out)) for n in names))).alias("x")).select("x.*")

    both = side(source, keys[0], "source").join(side(target, keys[1], "target"), "check")
    return both.select("check", "source", "target", (F.col("target") - F.col("source")).alias("difference"), percent_change(F.col("source"), F.col("target")).alias("percentage_difference"), (F.col("source") == F.col("target")).alias("matched"))


def volume_metrics(source: DataFrame, target: DataFrame, spec: ReconSpec) -> DataFrame:
    """One row: counts of both sides, coverage, duplicate rates, status."""
    s = key_counts(source, [k for k, _ in spec.keys]).select(*(F.col(c).alias(f"source_{c}") for c in ("total_rows", "distinct_keys", "duplicate_rows")))
    t = key_counts(target, [k for _, k in spec.keys]).select(*(F.col(c).alias(f"target_{c}") for c in ("total_rows", "distinct_keys", "duplicate_rows")))
    nulls = mapped_null_counts(source, target, spec).agg(F.count_if(~F.col("matched")).alias("null_mismatches"))
    both = s.join(t, F.lit(True)).join(nulls, F.lit(True))  # one row each
    coverage = F.when(F.col("source_total_rows") == 0, F.when(F.col("target_total_rows") == 0, 100.0)).otherwise(rate_pct(F.col("target_total_rows"), F.col("source_total_rows")))
    same = (F.col("source_total_rows") == F.col("target_total_rows")) & (F.col("source_distinct_keys") == F.col("target_distinct_keys")) & (F.col("source_duplicate_rows") == F.col("target_duplicate_rows")) & (F.col("null_mismatches") == 0)
    return both.withColumns(
        {
            "volume_coverage_pct": coverage,
            "source_duplicate_rate_pct": rate_pct(F.col("source_duplicate_rows"), F.col("source_total_rows")),
            "target_duplicate_rate_pct": rate_pct(F.col("target_duplicate_rows"), F.col("target_total_rows")),
            "status": F.when(same, "PASS").otherwise("FAIL"),
        }
    )
