"""Profiles by sketches against exact counts."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from congruity.operators.sketches import column_profiles, compared, in_numbers, merged
from congruity.spec import SpecError

NAMES = ["n", "x", "t", "at", "l", "none"]


def rows(spark, n=30_000, seed=1):
    rng = random.Random(seed)
    some = [(k % 7, rng.randrange(5000), None if k % 10 == 0 else rng.expovariate(1), rng.choice(["a", "b", "ü"]), datetime(2024, 1, 1 + k % 28), [k % 3], None) for k in range(n)]
    some[5] = (5, None, math.nan, None, None, None, None)
    return spark.createDataFrame(some, "day int, n int, x double, t string, at timestamp, l array<int>, none double")


def test_merged_parts_equal_one_profile(spark):
    df = rows(spark)
    exact = df.agg(*(F.count_distinct(c).alias(c) for c in NAMES), F.percentile("x", 0.5).alias("median")).first()
    parts = column_profiles(df, NAMES, ("day",))
    assert parts.count() == 7 * len(NAMES)
    for found in (in_numbers(merged(parts)), in_numbers(merged(merged(parts.withColumn("half", F.col("day") % 2), ("half",)))), in_numbers(column_profiles(df, NAMES))):
        got = {r["column"]: r for r in found.collect()}
        for c in NAMES:
            assert got[c].rows == 30_000 and got[c].nulls == df.filter(F.col(c).isNull()).count()
            assert abs(got[c].distinct - exact[c]) <= 0.03 * exact[c] + (c == "x")
        assert (got["n"].low, got["n"].high) == (0, 4999) and (got["t"].low_text, got["t"].high_text, got["t"].low) == ("a", "ü", None)
        assert abs(df.filter(F.col("x") <= got["x"].quantiles[1]).count() / df.filter("x IS NOT NULL AND NOT isnan(x)").count() - 0.5) < 0.02
        assert got["none"].quantiles is None and got["l"].quantiles is None and got["none"].distinct == 0


def test_a_new_part_joins_without_reading_the_others(spark, tmp_path):
    df, path = rows(spark, 4000), str(tmp_path / "p")
    for day in range(7):
        column_profiles(df.filter(f"day = {day}"), ["n", "t"]).withColumn("day", F.lit(day)).write.mode("append").parquet(path)
    got = {r["column"]: r for r in in_numbers(merged(spark.read.parquet(path))).collect()}
    want = {r["column"]: r for r in in_numbers(column_profiles(df, ["n", "t"])).collect()}
    assert {c: (r.rows, r.nulls, r.low, r.high, r.low_text, r.distinct) for c, r in got.items()}.keys() == want.keys()
    assert all((got[c].rows, got[c].nulls, got[c].low, got[c].low_text) == (want[c].rows, want[c].nulls, want[c].low, want[c].low_text) and abs(got[c].distinct - want[c].distinct) <= 0.02 * want[c].distinct for c in want)


def test_sides_are_compared(spark):
    s = rows(spark, 8000)
    t = rows(spark, 8000, 2).withColumn("x", F.col("x") + F.when(F.col("day") > 3, 2.0).otherwise(0.0))
    found = {r["column"]: r for r in compared(merged(column_profiles(s, NAMES, ("day",))), merged(column_profiles(t, NAMES)), {c: c for c in NAMES}, 5.0).collect()}
    assert not found["x"].matched and found["x"].apart > 0.1 and found["n"].matched and found["t"].matched and found["t"].apart is None and found["none"].matched
    same = compared(column_profiles(s, NAMES), column_profiles(s, NAMES), {c: c for c in NAMES})
    assert all(r.matched for r in same.collect())


def test_empty_tables_and_wrong_names(spark):
    got = in_numbers(column_profiles(rows(spark, 20).limit(0), ["n", "t"])).collect()
    assert [(r["column"], r.rows, r.nulls, r.low, r.distinct, r.quantiles) for r in got] == [("n", 0, 0, None, 0, None), ("t", 0, 0, None, 0, None)]
    for columns, by in (([], ()), (["n"], ("rows",))):
        with pytest.raises(SpecError):
            column_profiles(rows(spark, 20), columns, by)
