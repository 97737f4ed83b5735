"""Profiles that add up: a day's profile joins the others without reading them again.

A part (a day, a file, a partition) keeps for each column its rows and nulls, its least
and greatest value, a HyperLogLog sketch of its distinct values and a KLL sketch of its
numbers. Parts are merged by sums, minima and unions of sketches, in any order. Rows,
nulls and ends are exact (numbers as doubles); distinct values have a standard error of
1.04 / sqrt(2 ** LG_K), 0.8 %, and quantiles a rank error of about 0.7 %. The exact
counts are those of ``profile.key_counts`` and of the quality checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, is_numeric, is_temporal, kind, number, rate_pct
from ..spec import require

#: Sizes of the sketches: 2 ** LG_K registers, and KLL's k.
LG_K, KLL_K = 14, 400
QUANTILES = (0.25, 0.5, 0.75)
#: Steps of the running shares that sides are compared by.
GRID = 100


def measured(t: T.DataType) -> bool:
    return is_numeric(t) or is_temporal(t)


def hashable(c: Column, t: T.DataType) -> Column:
    """Values as the sketch takes them; equal ones stay equal."""
    return c if isinstance(t, (T.LongType, T.IntegerType, T.StringType)) else c.cast("string") if isinstance(t, T.AtomicType) else F.to_json(c)


def column_profiles(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """by.., column, rows, nulls, low, high, low_text, high_text, distinct, numbers: a row
    for each part and column, from one aggregate over the table."""
    require(columns, "a profile needs columns")
    require(not {"column", "rows", "nulls", "low", "high", "low_text", "high_text", "distinct", "numbers"} & set(by), "a part is named like a part of the profile")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        c, t = col(name), kind(df, name)
        aggs += [F.count_if(c.isNull()).alias(f"n{i}"), F.hll_sketch_agg(hashable(c, t), LG_K).alias(f"d{i}")]
        if measured(t):
            x = number(c, t)
            x = F.when(~F.isnan(x), x)
            aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.kll_sketch_agg_double(x, KLL_K).alias(f"q{i}")]
        elif isinstance(t, T.StringType):
            aggs += [F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")]
    keys = [col(b).alias(b) for b in by]
    row = (df.groupBy(*keys) if keys else df).agg(*aggs)
    known, out = set(row.columns), []
    for i, name in enumerate(columns):
        numeric = f"q{i}" in known
        pick = lambda x, kind, i=i, numeric=numeric: (F.col(f"{x}{i}") if f"{x}{i}" in known and numeric == (kind == "double") else F.lit(None)).cast(kind)
        out.append(
            F.struct(
                F.lit(name).alias("column"), "rows", F.col(f"n{i}").alias("nulls"), pick("a", "double").alias("low"), pick("b", "double").alias("high"), pick("a", "string").alias("low_text"),
                pick("b", "string").alias("high_text"), F.col(f"d{i}").alias("distinct"), (F.col(f"q{i}") if numeric else F.lit(None).cast("binary")).alias("numbers"),
            )
        )
    return row.select(*by, F.explode(F.array(*out)).alias("p")).select(*by, "p.*")


def merged(profiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The profiles of coarser parts, or of the whole: as if those had been read at once."""
    return profiles.groupBy(*by, "column").agg(
        *(F.sum(c).alias(c) for c in ("rows", "nulls")), *(F.min(c).alias(c) for c in ("low", "low_text")), *(F.max(c).alias(c) for c in ("high", "high_text")),
        F.hll_union_agg("distinct", True).alias("distinct"), F.kll_merge_agg_double("numbers").alias("numbers"),
    ).select(*by, "column", "rows", "nulls", "low", "high", "low_text", "high_text", "distinct", "numbers")


def in_numbers(profiles: DataFrame) -> DataFrame:
    """The profiles with distinct values and quantiles in the place of the sketches."""
    some = F.col("numbers").isNotNull() & F.col("low").isNotNull()
    quantiles = F.when(some, F.array(*(F.kll_sketch_get_quantile_double("numbers", F.lit(q)) for q in QUANTILES)))
    return profiles.select(*(c for c in profiles.columns if c not in ("distinct", "numbers")), F.hll_sketch_estimate("distinct").alias("distinct"), quantiles.alias("quantiles"))


def compared(source: DataFrame, target: DataFrame, names: dict[str, str], tolerance_pct: float = 3.0) -> DataFrame:
    """column, target_column, and for both sides null rates and distinct values, apart
    (how far their running shares are from each other at the source's quantiles, in steps
    of 1 / GRID), matched: from two merged profiles. ``tolerance_pct`` is above what the
    sketches may be off."""
    s, t = source.select(F.struct(*source.columns).alias("s")), target.select(F.struct(*target.columns).alias("t"))
    pairs = source.sparkSession.createDataFrame(list(names.items()), "column string, target_column string")
    both = pairs.join(s, F.col("s.column") == F.col("column")).join(t, F.col("t.column") == F.col("target_column"))
    some = F.col("s.low").isNotNull() & F.col("t.low").isNotNull() & F.col("s.numbers").isNotNull() & F.col("t.numbers").isNotNull()
    grid = {k: F.array(*(F.kll_sketch_get_quantile_double(f"{k}.numbers", F.lit(q / GRID)) for q in range(1, GRID))) for k in "st"}
    upto = lambda k, x: F.size(F.filter(grid[k], lambda y: y <= x))
    gaps = [F.abs(upto("s", x) - upto("t", x)) for x in (F.kll_sketch_get_quantile_double("s.numbers", F.lit(q)) for q in QUANTILES)]
    apart = F.when(some, F.greatest(*gaps) / GRID)
    rates = {f"{x}_null_pct": rate_pct(F.col(f"{k}.nulls"), F.col(f"{k}.rows")) for x, k in (("source", "s"), ("target", "t"))}
    counts = {f"{x}_distinct": F.hll_sketch_estimate(f"{k}.distinct") for x, k in (("source", "s"), ("target", "t"))}
    out = both.select("column", "target_column", *(c.alias(n) for n, c in {**rates, **counts}.items()), apart.alias("apart"))
    most = F.greatest("source_distinct", "target_distinct")
    near = (F.abs(F.col("source_distinct") - F.col("target_distinct")) * 100 <= most * tolerance_pct) & (F.abs(F.col("source_null_pct") - F.col("target_null_pct")) <= tolerance_pct)
    return out.withColumn("matched", near & F.coalesce(F.col("apart") * 100 <= tolerance_pct, F.lit(True)))
