"""Level 5: do aggregates of both sides agree."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, every, gap, is_numeric, kind, number, rate_pct
from ..spec import AggregateRule, limits

#: Of sums of doubles: how far their order may move them, as a share of their size.
ROUNDING = 1e-9
FUNCTIONS = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def aggregate(df: DataFrame, function: str, name: str | None) -> Column:
    """Exact for whole numbers and decimals, else a double; moments as seconds since 1970."""
    if function == "COUNT":
        return F.count(col(name)) if name else F.count(F.lit(1))
    t = kind(df, name)
    if function in ("SUM", "AVG") and isinstance(t, (T.DecimalType, T.IntegralType)):
        total = F.sum(col(name).cast(T.DecimalType(38, t.scale if isinstance(t, T.DecimalType) else 0)))  # exact, whatever the order of rows
        return total if function == "SUM" else total.cast("double") / F.count(col(name))
    out = FUNCTIONS[function](number(col(name), t) if isinstance(t, T.StringType) else col(name)) if function in ("MIN", "MAX") else FUNCTIONS[function](number(col(name), t))
    if function in ("MIN", "MAX") and not is_numeric(t):
        return number(out, T.DoubleType() if isinstance(t, T.StringType) else t)
    return out


def nulls(df: DataFrame, name: str | None) -> Column:
    """Rows whose value is null, or text that is blank."""
    if not name:
        return F.lit(0).cast("long")
    blank = F.trim(col(name)) == "" if isinstance(kind(df, name), T.StringType) else F.lit(False)
    return F.count_if(col(name).isNull() | blank)


def agrees(rule: AggregateRule, s: Column, difference: Column, same: Column, rounded: bool = False) -> Column:
    """Sums of doubles (``rounded``) depend on the order of rows in their last digits: they
    agree within ROUNDING of their size, whatever the tolerance."""
    if rounded:
        same = same | F.coalesce(F.abs(difference) <= F.abs(s.cast("double")) * ROUNDING, F.lit(False))
    absolute, pct = limits(rule.tolerance, rule.tolerance_pct)
    if absolute is not None:
        same = same | F.coalesce(F.abs(difference) <= F.lit(float(absolute)), F.lit(False))
    if pct is not None:
        same = same | F.coalesce(F.abs(difference) <= F.abs(s.cast("double")) * (pct / 100), F.lit(False))
    return same


CHECKS = "rule string, group array<string>, source_value double, target_value double, difference double, source_nulls long, target_nulls long, in_source boolean, in_target boolean, matched boolean"


def aggregate_checks(source: DataFrame, target: DataFrame, rules: tuple[AggregateRule, ...]) -> DataFrame:
    """rule, group (array of text), source_value, target_value, difference, source_nulls,
    target_nulls (rows without a value), in_source, in_target, matched: a row per enabled
    rule and group.

    Rules of one grouping share one aggregate a side; without grouping that is one
    job a side for all rules. A group of one side only does not match. Sums of whole
    numbers and decimals are compared exactly and shown as doubles.
    """
    by = defaultdict(list)
    for r in rules:
        if r.enabled:
            by[r.source_group_by, r.target_group_by].append(r)
    out = source.sparkSession.createDataFrame([], CHECKS)
    for (s_by, t_by), some in by.items():
        def side(df: DataFrame, names: tuple[str, ...], column: str, out_name: str, some=some) -> DataFrame:
            keys = [col(n).alias(f"g{i}") for i, n in enumerate(names)]
            aggs = [aggregate(df, r.function, getattr(r, column)).alias(f"{out_name}{i}") for i, r in enumerate(some)]
            aggs += [nulls(df, getattr(r, column)).alias(f"{out_name}_nulls{i}") for i, r in enumerate(some)]
            return (df.groupBy(*keys) if keys else df).agg(*aggs).withColumn(f"has_{out_name}", F.lit(True))

        s, t = side(source, s_by, "source_column", "s"), side(target, t_by, "target_column", "t")
        gs = [f"g{i}" for i in range(len(s_by))]
        same = every([F.col(f"s.{g}").eqNullSafe(F.col(f"t.{g}")) for g in gs])
        joined = s.alias("s").join(t.alias("t"), same, "full_outer" if gs else "inner")
        group = F.array(*(F.coalesce(F.col(f"s.{g}").cast("string"), F.col(f"t.{g}").cast("string")) for g in gs)).cast("array<string>")
        checks = []
        for i, r in enumerate(some):
            a, b = F.col(f"s{i}"), F.col(f"t{i}")
            difference = gap(a, kind(s, f"s{i}"), b, kind(t, f"t{i}"))
            inexact = any(isinstance(kind(df, c), (T.FloatType, T.DoubleType, T.StringType)) for df, c in ((source, r.source_column), (target, r.target_column)) if c)
            rounded = r.function in ("SUM", "AVG") and inexact
            checks.append(
                F.struct(
                    F.lit(r.name).alias("rule"), a.cast("double").alias("source_value"), b.cast("double").alias("target_value"), difference.alias("difference"),
                    F.coalesce(f"s_nulls{i}", F.lit(0)).alias("source_nulls"), F.coalesce(f"t_nulls{i}", F.lit(0)).alias("target_nulls"), agrees(r, a, difference, a.eqNullSafe(b), rounded).alias("ok"),
                )
            )
        rows = joined.select(group.alias("group"), F.coalesce("has_s", F.lit(False)).alias("in_source"), F.coalesce("has_t", F.lit(False)).alias("in_target"), F.explode(F.array(*checks)).alias("c"))
        rows = rows.select("c.rule", "group", "c.source_value", "c.target_value", "c.difference", "c.source_nulls", "c.target_nulls", "in_source", "in_target", (F.col("in_source") & F.col("in_target") & F.col("c.ok")).alias("matched"))
        out = out.unionByName(rows)
    return out


def aggregate_metrics(checks: DataFrame) -> DataFrame:
    row = checks.agg(F.count(F.lit(1)).alias("checks_total"), F.count_if("matched").alias("checks_passed"))
    return row.withColumns({"pass_rate_pct": rate_pct(F.col("checks_passed"), F.col("checks_total"), 100.0), "status": F.when(F.expr("checks_total = checks_passed"), "PASS").otherwise("FAIL")})
