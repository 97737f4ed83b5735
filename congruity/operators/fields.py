"""Level 4: which cells of matched rows differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, gap, is_numeric, normalize, normalized_type, rate_pct, within
from ..spec import Mapping
from .records import MATCHED


def fields_of(records: DataFrame, which: str) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in records.schema[which].dataType.fields}


def values(m: Mapping, st: T.DataType, tt: T.DataType) -> tuple[Column, Column, T.DataType, T.DataType]:
    s, t = normalize(col(m.source, "s"), st, m.normalization), normalize(col(m.target, "t"), tt, m.normalization)
    return s, t, normalized_type(st, m.normalization), normalized_type(tt, m.normalization)


def mismatch(m: Mapping, st: T.DataType, tt: T.DataType) -> Column:
    s, t, a, b = values(m, st, tt)
    return ~within(s, t, a, b, m)


def text(c: Column, t: T.DataType) -> Column:
    return c.cast("string") if isinstance(t, T.AtomicType) else F.to_json(c)


def field_mismatches(records: DataFrame, pairs: list[Mapping], n_keys: int = 1) -> DataFrame:
    """k0.., ordinals, source_column, target_column, values as text, difference
    (target less source, of numbers), comparison: one row per cell that differs."""
    st, tt = fields_of(records, "s"), fields_of(records, "t")
    cells = []
    for m in pairs:
        s, t, a, b = values(m, st[m.source], tt[m.target])
        difference = gap(s, a, t, b) if is_numeric(a) and is_numeric(b) else F.lit(None).cast("double")
        cell = F.struct(
            F.lit(m.source).alias("source_column"), F.lit(m.target).alias("target_column"), text(col(m.source, "s"), st[m.source]).alias("source_value"),
            text(col(m.target, "t"), tt[m.target]).alias("target_value"), difference.alias("difference"), F.lit(m.comparison).alias("comparison"),
        )
        cells.append(F.when(mismatch(m, st[m.source], tt[m.target]), cell))
    matched = records.filter(F.col("status") == MATCHED)
    keys = [f"k{i}" for i in range(n_keys)]
    long = matched.select(*keys, "source_ordinal", "target_ordinal", F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return long.select(*keys, "source_ordinal", "target_ordinal", "c.*")


def field_stats(records: DataFrame, pairs: list[Mapping]) -> DataFrame:
    """source_column, compared, mismatches, conformity_pct: all fields in one pass."""
    st, tt = fields_of(records, "s"), fields_of(records, "t")
    row = records.filter(F.col("status") == MATCHED).agg(F.count(F.lit(1)).alias("compared"), *(F.count_if(mismatch(m, st[m.source], tt[m.target])).alias(f"m{i}") for i, m in enumerate(pairs)))
    out = row.select("compared", F.explode(F.array(*(F.struct(F.lit(m.source).alias("source_column"), F.col(f"m{i}").alias("mismatches")) for i, m in enumerate(pairs)))).alias("x"))
    return out.select("x.source_column", "compared", "x.mismatches", rate_pct(F.col("compared") - F.col("mismatches"), F.col("compared"), 100.0).alias("conformity_pct"))


def mismatches_of(records: DataFrame, pairs: list[Mapping]) -> Column:
    """Cells of a matched pair that differ; 0 of others."""
    st, tt = fields_of(records, "s"), fields_of(records, "t")
    count = sum((mismatch(m, st[m.source], tt[m.target]).cast("long") for m in pairs), F.lit(0).cast("long"))
    return F.when(F.col("status") == MATCHED, count).otherwise(0)


def field_metrics(records: DataFrame, pairs: list[Mapping], n_keys: int = 1) -> DataFrame:
    """One row: matched pairs, compared cells, mismatches, keys with any, rates, status."""
    rows = records.filter(F.col("status") == MATCHED).select(*(f"k{i}" for i in range(n_keys)), mismatches_of(records, pairs).alias("n"))
    per_key = rows.groupBy(*(f"k{i}" for i in range(n_keys))).agg(F.count(F.lit(1)).alias("p"), F.sum("n").alias("n"))
    row = per_key.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("matched_pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("mismatches"), F.count_if(F.col("n") > 0).alias("keys_with_mismatch"))
    row = row.withColumn("compared", F.col("matched_pairs") * len(pairs))
    return row.withColumns(
        {
            "conformity_pct": rate_pct(F.col("compared") - F.col("mismatches"), F.col("compared"), 100.0),
            "affected_pct": rate_pct(F.col("keys_with_mismatch"), F.col("matched_pairs")),
            "status": F.when(F.col("mismatches") == 0, "PASS").otherwise("FAIL"),
        }
    )


def row_hash(df: DataFrame, columns: list[tuple[str, dict]]) -> Column:
    """SHA-256 of a row's normalised values. Nulls carry a flag of their own and texts
    their length, so no values can pass for others."""
    parts = []
    for name, how in columns:
        v = text(normalize(col(name), df.schema[name].dataType, how), df.schema[name].dataType)
        parts.append(F.coalesce(F.concat(F.lit("1"), F.length(v).cast("string"), F.lit(":"), v), F.lit("0")))
    return F.sha2(F.concat(*parts), 256)
