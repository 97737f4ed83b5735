"""Level 6: do rows satisfy rules; and rules that compare the two sides' quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, every, kind, number, percent_change, rate_pct
from ..spec import Mapping, QualityRule, ReconSpec, limits, require
from .records import MATCHED, UNMATCHABLE, reconcile_records

SCHEMA = "rule string, side string, total long, failed long, pass_pct double"


def violation(df: DataFrame, rule: QualityRule, name: str) -> Column:
    """True for a row that breaks the rule; null counts as unbroken."""
    c, t = col(name), kind(df, name)
    blank = c.isNull() | (F.trim(c.cast("string")) == "")
    if rule.rule == "COMPLETENESS":
        return blank
    if rule.rule == "PATTERN":
        found = c.cast("string").rlike(f"^(?:{rule.regex})$" if rule.full_match else rule.regex)
        return F.coalesce(~found, F.lit(rule.nulls_fail))
    if rule.allowed:
        return F.coalesce(~c.isin(*rule.allowed), F.lit(rule.nulls_fail))
    n = number(c, t)
    good = F.lit(True)
    if rule.minimum is not None:
        good = good & (n >= rule.minimum)
    if rule.maximum is not None:
        good = good & (n <= rule.maximum)
    return ~F.coalesce(good, F.lit(False))


def quality_checks(source: DataFrame, target: DataFrame, rules: tuple[QualityRule, ...]) -> DataFrame:
    """rule, side, total, failed, pass_pct: all rules of a side in one aggregate."""
    out = source.sparkSession.createDataFrame([], SCHEMA)
    for df, side, column in ((source, "SOURCE", "source_column"), (target, "TARGET", "target_column")):
        some = [r for r in rules if r.enabled and r.apply_to in (side, "BOTH") and getattr(r, column) in df.columns]
        if some:
            row = df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(violation(df, r, getattr(r, column))).alias(f"f{i}") for i, r in enumerate(some)))
            long = row.select("total", F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"f{i}").alias("failed")) for i, r in enumerate(some)))).alias("x"))
            out = out.unionByName(long.select("x.rule", F.lit(side).alias("side"), "total", "x.failed", rate_pct(F.col("total") - F.col("failed"), F.col("total"), 100.0).alias("pass_pct")))
    return out


def quality_verdicts(checks: DataFrame, rules: tuple[QualityRule, ...]) -> DataFrame:
    """rule, source_failed, target_failed, source_rate, target_rate, matched: a row per rule.

    A rule of both sides holds where they fail alike, a rule of one side where it does
    not fail, within its tolerance: a number or "absolute" counts rows for VALIDITY and
    per cent points of the rate for others, "percentage" is of the rate for all and goes
    first. Without any, rates of both sides must be equal."""
    on = {r.name: r for r in rules if r.enabled}
    rate, side = rate_pct(F.col("failed"), F.col("total")), F.col("side")
    pick = [F.max(F.when(side == x, c)).alias(f"{x.lower()}_{what}") for x in ("SOURCE", "TARGET") for what, c in (("failed", F.col("failed")), ("rate", rate))]
    out = checks.filter(F.col("rule").isin(*on)).groupBy("rule").agg(*pick)

    def near(r: QualityRule) -> Column:
        absolute, pct = limits(r.tolerance)
        what, limit = ("failed", absolute) if r.rule == "VALIDITY" and pct is None and absolute is not None else ("rate", pct if pct is not None else absolute)
        a, b = F.col(f"source_{what}"), F.col(f"target_{what}")
        far = F.abs(b - a) if r.apply_to == "BOTH" else a if r.apply_to == "SOURCE" else b
        return F.coalesce(far <= F.lit(float(limit or 0)), F.lit(False))

    matched = F.lit(False)
    for r in on.values():
        matched = F.when(F.col("rule") == r.name, near(r)).otherwise(matched)
    return out.withColumn("matched", matched)


def failing_rows(df: DataFrame, rule: QualityRule, name: str) -> DataFrame:
    return df.filter(violation(df, rule, name))


def quality_metrics(checks: DataFrame) -> DataFrame:
    row = checks.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))
    return row.withColumns({"pass_pct": rate_pct(F.col("total") - F.col("failed"), F.col("total"), 100.0), "status": F.when(F.col("failed") == 0, "PASS").otherwise("FAIL")})


def rate_comparison(checks: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Failure rates of both sides of each rule, within ``tolerance`` per cent points."""
    rate = rate_pct(F.col("failed"), F.col("total"))
    out = checks.groupBy("rule").agg(F.max(F.when(F.col("side") == "SOURCE", rate)).alias("source_rate"), F.max(F.when(F.col("side") == "TARGET", rate)).alias("target_rate"))
    return out.withColumn("matched", F.coalesce(F.abs(F.col("target_rate") - F.col("source_rate")) <= tolerance, F.lit(False)))


def inconsistent(columns: list[str]) -> Column:
    """Whether the columns of a row differ after trimming and lower-casing."""
    first, *rest = [F.lower(F.trim(col(c).cast("string"))) for c in columns]
    return ~every([first.eqNullSafe(r) for r in rest])


def consistency(source: DataFrame, target: DataFrame, source_columns: list[str], target_columns: list[str]) -> DataFrame:
    """One row: rows of either side whose columns are not all equal, matched."""
    s, t = source.agg(F.count_if(inconsistent(source_columns)).alias("source_failed")), target.agg(F.count_if(inconsistent(target_columns)).alias("target_failed"))
    return s.join(t, F.lit(True)).withColumn("matched", F.col("source_failed") == F.col("target_failed"))


def timeliness(source: DataFrame, target: DataFrame, source_column: str, target_column: str, tolerance_seconds: float) -> DataFrame:
    """One row: seconds between the latest moments of the sides, matched."""
    def latest(df: DataFrame, name: str, out: str) -> DataFrame:
        c = col(name).try_cast("timestamp") if isinstance(kind(df, name), T.StringType) else col(name).cast("timestamp")
        return df.agg((F.unix_micros(F.max(c)) / 1e6).alias(out))

    both = latest(source, source_column, "source_latest").join(latest(target, target_column, "target_latest"), F.lit(True))
    return both.withColumn("latency_seconds", F.abs(F.col("target_latest") - F.col("source_latest"))).withColumn("matched", F.coalesce(F.col("latency_seconds") <= tolerance_seconds, F.lit(False)))


def referential(target: DataFrame, source: DataFrame, target_column: str, source_column: str) -> DataFrame:
    """value, rows: target values that the source lacks; a null is a value."""
    values = target.groupBy(col(target_column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    known = source.select(col(source_column).alias("known")).distinct()
    return values.join(known, F.col("value").eqNullSafe(F.col("known")), "left_anti")


def distribution(source: DataFrame, target: DataFrame, source_column: str, target_column: str, tolerance: float) -> DataFrame:
    """value, source_pct, target_pct, difference, matched, nulls among the values."""
    def share(df: DataFrame, name: str, out: str) -> DataFrame:
        counts = df.groupBy(col(name).alias(f"{out}_value")).agg(F.count(F.lit(1)).alias("n"))
        total = df.agg(F.count(F.lit(1)).alias("total"))
        return counts.join(total, F.lit(True)).select(f"{out}_value", F.round(F.col("n") / F.col("total") * 100, 4).alias(f"{out}_pct"), F.lit(True).alias(f"in_{out}"))

    s, t = share(source, source_column, "source"), share(target, target_column, "target")
    joined = s.join(t, F.col("source_value").eqNullSafe(F.col("target_value")), "full_outer")
    out = joined.select(F.when(F.col("in_source"), F.col("source_value")).otherwise(F.col("target_value")).alias("value"), F.coalesce("source_pct", F.lit(0.0)).alias("source_pct"), F.coalesce("target_pct", F.lit(0.0)).alias("target_pct"))
    gap = F.round(F.abs(F.col("target_pct") - F.col("source_pct")), 4)
    return out.withColumn("difference", gap).withColumn("matched", gap <= tolerance)


def conditional(df: DataFrame, column: str, equals, then_column: str, then: str) -> DataFrame:
    """One row: rows where ``column`` equals a value, and those that then break
    NOT_NULL, NOT_EMPTY or POSITIVE of ``then_column``."""
    c = col(then_column)
    require(then in ("NOT_NULL", "NOT_EMPTY", "POSITIVE"), f"unknown condition {then}")
    bad = {"NOT_NULL": c.isNull(), "NOT_EMPTY": c.isNull() | (F.trim(c.cast("string")) == "")}.get(then)
    bad = ~F.coalesce(number(c, kind(df, then_column)) > 0, F.lit(False)) if bad is None else bad
    applies = F.coalesce(col(column) == F.lit(equals), F.lit(False))
    return df.agg(F.count_if(applies).alias("applicable"), F.count_if(applies & bad).alias("failed"))


#: The names of transformations.
TRANSFORMS = {"IDENTITY": lambda c, a: c, "LOWER": lambda c, a: F.lower(c), "UPPER": lambda c, a: F.upper(c), "STRIP": lambda c, a: F.trim(c), "ROUND": lambda c, a: F.round(c, a)}


def transformation(source: DataFrame, target: DataFrame, keys: list[tuple[str, str]], source_column: str, target_column: str, transform: str, digits: int = 0, tolerance: float = 0.0) -> DataFrame:
    """One row: keyed pairs, those whose target is not the transformed source, and rows
    of either side without a usable key. Pairs are those of ``reconcile_records``: rows
    of a key are ordered by the compared values and pair by ordinal."""
    require(transform in TRANSFORMS, f"unknown transformation {transform}")
    ks = [f"k{i}" for i in range(len(keys))]
    s = source.select(*(col(a).alias(k) for k, (a, _) in zip(ks, keys, strict=True)), TRANSFORMS[transform](col(source_column), digits).alias("want"))
    t = target.select(*(col(b).alias(k) for k, (_, b) in zip(ks, keys, strict=True)), col(target_column).alias("got"))
    a, b = s.schema["want"].dataType, t.schema["got"].dataType
    near = F.coalesce(F.abs(number(F.col("t.got"), b) - number(F.col("s.want"), a)) <= tolerance, F.lit(False)) if tolerance else F.lit(False)
    records = reconcile_records(s, t, ReconSpec(keys=tuple((k, k) for k in ks), mappings=(Mapping("want", "got"),)))
    paired = F.col("status") == MATCHED
    return records.agg(
        F.count_if(paired).alias("pairs"),
        F.count_if(paired & ~(F.col("s.want").eqNullSafe(F.col("t.got")) | near)).alias("failed"),
        *(F.count_if(F.col("status") == UNMATCHABLE[own]).alias(f"unmatchable_{side}") for own, side in (("s", "source"), ("t", "target"))),
    )


def scalar_pair(source: DataFrame, target: DataFrame, source_sql: str, target_sql: str, tolerance: float = 0.0) -> DataFrame:
    """One row: an aggregate expression of either side, compared as numbers."""
    both = source.agg(F.expr(source_sql).cast("double").alias("source_value")).join(target.agg(F.expr(target_sql).cast("double").alias("target_value")), F.lit(True))
    gap = F.abs(F.col("target_value") - F.col("source_value"))
    return both.withColumns({"change_pct": percent_change(F.col("source_value"), F.col("target_value")), "matched": F.col("source_value").eqNullSafe(F.col("target_value")) | F.coalesce(gap <= tolerance, F.lit(False))})


def quantile_borders(source: DataFrame, target: DataFrame, source_column: str, target_column: str, bins: int = 10, accuracy: int = 10_000) -> list[float]:
    """Borders of bins that hold about equal shares of both sides together, from one
    quantile sketch over them; a border is at most 1 / accuracy of the rows off."""
    require(bins >= 2, "a distribution needs two bins")
    both = source.select(number(col(source_column), kind(source, source_column)).alias("x")).unionByName(target.select(number(col(target_column), kind(target, target_column)).alias("x")))
    found = both.filter(~F.isnan("x")).agg(F.percentile_approx("x", [k / bins for k in range(1, bins)], accuracy).alias("b")).first()["b"]
    return sorted(set(found or ()))


def numeric_distribution(source: DataFrame, target: DataFrame, source_column: str, target_column: str, borders: list[float]) -> DataFrame:
    """bin, low, high, source_rows, target_rows, source_share, target_share, psi, ks: how
    two columns of numbers or moments (seconds since 1970) spread over common bins.

    A bin holds low <= x < high; the first and the last are open. One aggregate counts
    both sides; psi is the bin's part of the population stability index, where an empty
    bin counts as half a row, and ks the distance of both sides' running shares at the
    bin's end. Nulls and values that are no numbers are in bin -1, without psi and ks."""
    require(list(borders) == sorted(set(borders)), "borders must ascend")
    ends = [float(b) for b in borders]

    def side(df: DataFrame, name: str, own: str) -> DataFrame:
        return df.select(number(col(name), kind(df, name)).alias("x"), F.lit(own).alias("side"))

    x, n = F.col("x"), len(ends)
    at = sum((F.when(x >= b, 1).otherwise(0) for b in ends), F.lit(0))
    both = side(source, source_column, "s").unionByName(side(target, target_column, "t"))
    counted = both.groupBy(F.when(x.isNull() | F.isnan(x), -1).otherwise(at).alias("bin")).agg(*(F.count_if(F.col("side") == k).alias(f"{name}_rows") for k, name in (("s", "source"), ("t", "target"))))
    frame = [(-1, None, None), *((k, ends[k - 1] if k else None, ends[k] if k < n else None) for k in range(n + 1))]
    rows = source.sparkSession.createDataFrame(frame, "bin int, low double, high double").join(counted, "bin", "left")
    rows = rows.withColumns({f"{s}_rows": F.coalesce(f"{s}_rows", F.lit(0)) for s in ("source", "target")})
    # A row a bin from here on.
    whole, upto = Window.partitionBy(F.col("bin") >= 0), Window.partitionBy(F.col("bin") >= 0).orderBy("bin")
    values = F.col("bin") >= 0
    share = {s: F.when(values, F.try_divide(F.col(f"{s}_rows"), F.sum(f"{s}_rows").over(whole))) for s in ("source", "target")}
    smooth = {s: F.try_divide(F.greatest(F.col(f"{s}_rows"), F.lit(0.5)), F.sum(f"{s}_rows").over(whole)) for s in ("source", "target")}
    running = {s: F.try_divide(F.sum(f"{s}_rows").over(upto), F.sum(f"{s}_rows").over(whole)) for s in ("source", "target")}
    there = values & (F.sum("source_rows").over(whole) > 0) & (F.sum("target_rows").over(whole) > 0)
    return rows.select(
        "bin", "low", "high", "source_rows", "target_rows", share["source"].alias("source_share"), share["target"].alias("target_share"),
        F.when(there, (smooth["target"] - smooth["source"]) * F.ln(F.try_divide(smooth["target"], smooth["source"]))).alias("psi"), F.when(there, F.abs(running["target"] - running["source"])).alias("ks"),
    )


def distribution_shift(bins: DataFrame, psi_limit: float = 0.1, ks_limit: float = 0.1) -> DataFrame:
    """One row: psi, ks, null_difference (in per cent points), matched, from the bins of
    numeric_distribution()."""
    share = {s: F.try_divide(F.sum(F.when(F.col("bin") < 0, F.col(f"{s}_rows"))), F.sum(f"{s}_rows")) for s in ("source", "target")}
    row = bins.agg(F.sum("psi").alias("psi"), F.max("ks").alias("ks"), ((share["target"] - share["source"]) * 100).alias("null_difference"))
    return row.withColumn("matched", F.coalesce((F.col("psi") <= psi_limit) & (F.col("ks") <= ks_limit), F.lit(False)))
