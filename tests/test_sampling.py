"""Samples by key: members, estimates and how often their bounds hold."""

import random

import pytest
from pyspark.sql import functions as F

from congruity.operators import sampling
from congruity.operators.records import reconcile_records
from congruity.operators.sampling import METRICS, STEPS, draw, estimates, key_totals, rates, sample_sides, sampled_metrics, stratum_counts, wilson
from congruity.plans.reconcile import reconcile
from congruity.spec import Mapping, ReconSpec, SpecError

SPEC = ReconSpec(keys=(("region", "area"), ("id", "id")), mappings=(Mapping("amount", "total", tolerance=0.5), Mapping("name", "name", {"trim": True})))


def sides(spark, n=9000, seed=1):
    """Three strata of very different size and quality, keys that repeat, unusable keys."""
    rng = random.Random(seed)
    source, target = [], []
    for k in range(n):
        region = "small" if k % 150 == 0 else "bad" if k % 5 == 0 else "good"
        copies = 3 if k % 40 == 0 else 1
        source += [(region, k, float(k), "x", c) for c in range(copies)]
        if rng.random() < (0.7 if region == "bad" else 0.99):
            wrong = rng.random() < (0.3 if region == "bad" else 0.004)
            target += [(region, k, k + (5.0 if wrong else 0.3), " x") for _ in range(copies)]
        if rng.random() < 0.03:
            target.append((region, -1 - k, 0.0, "extra"))
    source += [(None, 1, 0.0, "", 0), ("good", None, 0.0, "", 0), (" ", 2, 0.0, "", 0)] * 2
    s = spark.createDataFrame(source, "region string, id long, amount double, name string, cut int")
    return s, spark.createDataFrame(target, "area string, id long, total double, name string")


def test_members_are_the_same_keys_on_both_sides(spark):
    s, t = sides(spark)
    a, b, rated = sample_sides(s, t, SPEC, 400, ("region",), 3)
    assert a.columns == s.columns and b.columns == t.columns
    keys = {(r.region, r.id) for r in a.collect()}
    other = {(r.area, r.id) for r in b.collect()}
    all_s, all_t = ({tuple(r) for r in x.select(*x.columns[:2]).collect() if r[0] and r[0].strip() and r[1] is not None} for x in (s, t))
    assert keys & all_t == other & all_s
    assert {k for k in all_s if k[0] == "small"} <= keys  # small strata are read whole
    assert 300 < sum(k[0] == "bad" for k in keys) < 500 and 300 < sum(k[0] == "good" for k in keys) < 500
    assert {r.h0: r.rate for r in rated.collect()}["small"] == 1
    again, _, _ = sample_sides(s.repartition(7), t, SPEC, 400, ("region",), 3)
    assert {(r.region, r.id) for r in again.collect()} == keys
    assert {(r.region, r.id) for r in sample_sides(s, t, SPEC, 400, ("region",), 4)[0].collect()} != keys


@pytest.mark.parametrize("strata", [(), ("region",)])
def test_bounds_hold_the_truth(spark, strata):
    s, t = sides(spark)
    totals = key_totals(reconcile_records(s, t, SPEC), SPEC, s.columns, t.columns).filter("trim(k0) != '' AND k1 IS NOT NULL").persist()
    sums = totals.agg(*(F.sum(c).alias(c) for c in ("covered", "differing", "extra", "source_rows", "target_rows"))).first()
    truth = {m: sums[y] / sums[x] for m, (y, x) in METRICS.items()}
    rated = rates(stratum_counts(s, t, SPEC, strata), 500)
    drawn = totals.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("n", draw([F.col("k0"), F.col("k1")], F.col("seed")))
    same = F.lit(True) if not strata else F.col("h0") == F.col("k0")
    keys = drawn.join(rated.select(*rated.columns[: len(strata)], "cut"), same & (F.col("n") < F.col("cut")))
    found = estimates(keys, rated, list(range(len(strata))), 0.99, by=("seed",)).collect()
    totals.unpersist()
    for m, x in truth.items():
        mine = [r for r in found if r.metric == m]
        assert len(mine) == 100 and sum(r.lower <= x <= r.upper for r in mine) >= 95, m
        assert abs(sum(r.estimate for r in mine) / 100 - x) < 0.01
        assert all(r.upper - r.lower < 0.2 and r.lower <= r.estimate <= r.upper for r in mine)


def test_a_sample_of_everything_is_exact(spark):
    s, t = sides(spark, 600)
    for strata in ((), ("region",)):
        rows = {r.metric: r for r in reconcile(s, t, SPEC).sampled(10**9, strata).collect()}
        records = reconcile(s, t, SPEC).metrics("L3").first()
        assert all(r.lower == r.estimate == r.upper and r.strata == r.exact_strata for r in rows.values())
        assert rows["coverage"].estimate == records.matched_source / (records.source_rows - records.unmatchable_source)
        assert rows["extra"].estimate == records.extra / records.target_rows and rows["coverage"].population == rows["coverage"].sampled_rows


def test_nothing_seen_is_not_nothing_there(spark):
    """Without a single mismatch in the sample the upper bound stays above zero."""
    s = spark.range(5000).select("id", F.lit("a").alias("v"))
    row = {r.metric: r for r in sampled_metrics(s, s, ReconSpec(keys=(("id", "id"),)), 300).collect()}["mismatch"]
    assert row.estimate == row.lower == 0 and 0.001 < row.upper < 0.05


def test_empty_sides_and_wrong_strata(spark):
    s, t = sides(spark, 40)
    none = sampled_metrics(s.limit(0), t.limit(0), SPEC, 10, ("region",)).collect()
    assert none == []
    one = {r.metric: r for r in sampled_metrics(s, t.limit(0), SPEC, 10**6, ("region",)).collect()}
    assert one["coverage"].estimate == 0 and "extra" not in one
    with pytest.raises(SpecError, match="stratum"):
        sample_sides(s, t, SPEC, 10, ("amount",))
    with pytest.raises(SpecError, match="keys"):
        sample_sides(s, t, ReconSpec(), 10)


def test_only_sampled_rows_are_shuffled(spark, monkeypatch):
    s, t = sides(spark, 300)
    a, _, _ = sample_sides(s, t, SPEC, 100, ("region",))
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange") == 1
    monkeypatch.setattr(sampling, "FEW", 1)
    assert sorted(sample_sides(s, t, SPEC, 100, ("region",))[0].collect()) == sorted(a.collect())


def test_wilson_bounds(spark):
    row = spark.range(1).select(*wilson(F.lit(0.1), F.lit(1 / 50), 1.959963984540054)).first()
    assert abs(row[0] - 0.04347) < 1e-4 and abs(row[1] - 0.21360) < 1e-4  # as published for 5 of 50
    assert STEPS == 2**32
