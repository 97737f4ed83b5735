"""Differences by checksums against the plain comparison."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from congruity.operators import checksum
from congruity.operators.checksum import BITS, Checksums, checksum_diff, descend
from congruity.operators.records import row_level_diff
from congruity.spec import Mapping, SpecError

COLUMNS = ["id", "a", "b", "day"]


def sides(spark, n=3000, seed=1):
    rng, start = random.Random(seed), date(2024, 1, 1)
    rows = [(None if k % 97 == 0 else k * 1000, rng.choice([None, "x", ""]), rng.choice([None, 0.0, -0.0, float("nan"), 1.5]), start + timedelta(k % 400)) for k in range(n)]
    other = [(i, a, 7.0 if k % 251 == 0 else b, d) for k, (i, a, b, d) in enumerate(rows) if k % 307]
    rows += rows[5:9] + [(None, None, None, None)] * 2
    other += [rows[11]] * 3 + [(None, None, None, None)]
    schema = "id long, a string, b double, day date"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)


def found(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("by", [None, "id", "day"])
def test_differences_equal_the_plain_comparison(spark, by):
    s, t = sides(spark)
    want = found(row_level_diff(s, t, COLUMNS))
    assert found(checksum_diff(s, t, COLUMNS, by)) == want and len(want) > 20
    assert checksum_diff(s, s.repartition(5), COLUMNS, by).collect() == []
    assert found(checksum_diff(s, t.limit(0), COLUMNS, by)) == found(row_level_diff(s, t.limit(0), COLUMNS))
    assert checksum_diff(s.limit(0), t.limit(0), COLUMNS, by).collect() == []


def test_nulls_and_repeats_count(spark):
    def one(*rows):
        return spark.createDataFrame(rows, "id long, a long")

    assert found(checksum_diff(one((None, 1)), one((1, None)), ["id", "a"])) == [("1", "None", "0", "1"), ("None", "1", "1", "0")]
    assert found(checksum_diff(one((1, 1), (1, 1), (2, 2)), one((1, 1), (2, 2), (2, 2)), ["id", "a"])) == [("1", "1", "2", "1"), ("2", "2", "1", "2")]


def test_types_and_normalised_values_meet(spark):
    s = spark.createDataFrame([(1, " A", 1.0), (2, "b", 2.5)], "id int, name string, x double")
    t = spark.createDataFrame([(1, "a", 1), (2, "B ", 2)], "key long, label string, x int")
    pairs = [Mapping("id", "key"), Mapping("name", "label", {"trim": True, "case_insensitive": True}), Mapping("x", "x")]
    assert found(Checksums(s, t, pairs).difference()) == [("2", "b", "2.0", "0", "1"), ("2", "b", "2.5", "1", "0")]
    money = spark.createDataFrame([("1.50",), ("2.25",)], "x string").select(F.col("x").cast("decimal(10,2)").alias("x"))
    assert Checksums(money, money.select(F.col("x").cast("decimal(12,4)").alias("x")), [Mapping("x", "x")]).difference().collect() == []


def test_only_what_differs_is_descended(spark):
    s, t = sides(spark)
    own = Checksums(s, t, [Mapping(c, c) for c in COLUMNS])
    a, b = own.digests(0).persist(), own.digests(1).persist()
    levels = {r.level: (r.buckets, r.n) for r in a.groupBy("level").agg(F.count("*").alias("buckets"), F.sum("n").alias("n")).collect()}
    assert set(levels) == {0, 1, 2, 3, 4} and levels[0] == (1, s.count()) and all(n == s.count() for _, n in levels.values())
    leaves = {r.bucket for r in descend(a, b).collect()}
    plain = a.filter("level = 4").select("bucket", F.struct("n", "low", "high2").alias("s")).join(b.filter("level = 4").select("bucket", F.struct("n", "low", "high2").alias("t")), "bucket", "full")
    assert leaves == {r.bucket for r in plain.filter(~F.col("s").eqNullSafe(F.col("t"))).collect()} and len(leaves) < 80
    assert found(own.difference(a, b)) == found(own.difference())  # kept digests
    assert descend(a, a).collect() == []
    for x in (a, b):
        x.unpersist()


def test_leaves_are_made_twice_a_side_for_all_levels(spark):
    """Once to be added to the buckets above them, once to be compared."""
    own = Checksums(*sides(spark), [Mapping(c, c) for c in COLUMNS])
    plan = own.differing()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(leaf") == 4
    assert own.digests(0).dtypes == spark.createDataFrame([], checksum.DIGESTS).dtypes


def test_a_leaf_is_found_below_buckets_that_differ(spark):
    """Trees made by hand, with buckets that differ below equal ones and buckets of one side alone."""
    rng = random.Random(2)
    leaves = sorted({rng.choice([rng.randrange(1 << BITS), rng.randrange(600)]) for _ in range(400)} | {0, (1 << BITS) - 1})
    buckets = sorted({(level, leaf >> (BITS - 4 * level)) for leaf in leaves for level in range(5)})
    trees = [{b: rng.choice([1, 1, 1, 2]) for b in buckets if b[0] == 0 or rng.random() < 0.95} for _ in range(2)]
    for root in ((1, 2), (1, 1)):
        for tree, n in zip(trees, root, strict=True):
            tree[0, 0] = n
        want = {leaf for leaf in leaves if all(trees[0].get(b) != trees[1].get(b) for b in ((level, leaf >> (BITS - 4 * level)) for level in range(5)))}
        s, t = (spark.createDataFrame([(level, b, n, *[0] * 4) for (level, b), n in tree.items()], "level int, bucket long, n long, low long, high long, low2 long, high2 long") for tree in trees)
        assert {r.bucket for r in descend(s, t).collect()} == want and bool(want) == (root[0] != root[1])


def test_ranges_reach_the_scan(spark, tmp_path):
    rows = spark.range(0, 200_000, 1, 4).select("id", (F.col("id") % 7).alias("v"))
    rows.repartitionByRange(8, "id").write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    t = s.filter("id < 150000 OR id >= 150010")
    out = checksum_diff(s, t, ["id", "v"], "id")
    assert out.count() == 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    pushed = [x for x in plan.split("PushedFilters: ")[1:] if "GreaterThanOrEqual(id," in x.split("]")[0]]
    assert len(pushed) >= 2 and "LessThan(id," in pushed[0]
    own = Checksums(s, t, [Mapping("id", "id"), Mapping("v", "v")], "id")
    read = s.filter(own.within(0, sorted(r.bucket for r in own.differing().collect()))).count()
    assert 10 <= read <= 50  # of 200,000


def test_many_ranges_are_taken_together(spark, monkeypatch):
    monkeypatch.setattr(checksum, "RANGES", 3)
    s = spark.range(0, 1 << BITS)
    own = Checksums(s, s.filter("id % 1000 != 1"), [Mapping("id", "id")], "id")
    leaves = sorted(r.bucket for r in own.differing().collect())
    assert leaves == list(range(1, 1 << BITS, 1000))
    kept = own.within(0, leaves)
    assert s.filter(kept).count() >= len(leaves) and {r.id for r in s.filter(kept).collect()} >= set(leaves)
    near = own.within(0, [5, 6, 7, 900, 901, 50_000])
    assert {r.id for r in s.filter(near).collect()} == {5, 6, 7, 900, 901, 50_000}
    assert own.difference().count() == len(leaves)


def test_wrong_columns_are_refused(spark):
    s, t = sides(spark, 10)
    for by in ("a", "b", "nothing"):
        with pytest.raises(SpecError):
            checksum_diff(s, t, COLUMNS, by)
    with pytest.raises(SpecError):
        checksum_diff(s, t, [])
