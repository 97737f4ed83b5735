import random
from collections import Counter
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from congruity.operators import aggregates, fields, groups, profile, quality, records, schema_diff
from congruity.operators.filters import apply_filters
from congruity.plans.reconcile import latest_results, reconcile
from congruity.spec import AggregateRule, GroupSpec, Mapping, QualityRule, ReconSpec, RowFilter, SpecError

SPEC = ReconSpec(keys=(("k", "k"),))
SCHEMA = "k string, name string, n int"
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


SOURCE = [("a", "Alpha", 1), ("a", "Alpha two", 2), ("b", "Beta", 3), ("c", "Gamma", None), (None, "Delta", 5), ("  ", "Eps", 6)]
TARGET = [("a", " alpha ", 1), ("b", "Beta", 4), ("b", "Beta", 3), ("b", "Beta", 9), ("d", "Delta", 5), (None, "Zeta", 0)]


def test_statuses_and_pairs(spark):
    r = reconcile(frame(spark, SOURCE), frame(spark, TARGET), SPEC)
    got = Counter((x.k0, x.status, x.source_ordinal, x.target_ordinal) for x in r.records.collect())
    assert got == Counter(
        [
            ("a", "MATCHED", 1, 1), ("a", "MATCHED", 2, 1), ("b", "MATCHED", 1, 1), ("b", "MATCHED", 1, 2), ("b", "MATCHED", 1, 3), ("c", "MISSING_IN_TARGET", 1, None), ("d", "EXTRA_IN_TARGET", None, 1),
            (None, "UNMATCHABLE_SOURCE", None, None), ("  ", "UNMATCHABLE_SOURCE", None, None), (None, "UNMATCHABLE_TARGET", None, None),
        ]
    )
    m = r.metrics("L3").first()
    assert (m.matched_pairs, m.matched_source, m.matched_target, m.missing, m.extra, m.source_rows, m.target_rows) == (5, 3, 4, 1, 1, 6, 6)
    assert {(x.k0, x.source_rows, x.target_rows, x.pairs) for x in records.duplicate_keys(r.records).collect()} == {("a", 2, 1, 2), ("b", 1, 3, 3)}


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.just("x"), st.integers(0, 3)), max_size=7), st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.just("x"), st.integers(0, 3)), max_size=7))
def test_n_and_m_rows_of_a_key_give_the_larger_number_of_pairs(spark, source, target):
    r = reconcile(frame(spark, source), frame(spark, target), SPEC)
    got = Counter((x.k0, x.status) for x in r.records.collect())
    s, t = Counter(x[0] for x in source), Counter(x[0] for x in target)
    want = Counter()
    for k in {*s, *t} - {None}:
        want[k, "MATCHED" if s[k] and t[k] else "MISSING_IN_TARGET" if s[k] else "EXTRA_IN_TARGET"] = max(s[k], t[k])
    if s[None]:
        want[None, "UNMATCHABLE_SOURCE"] = s[None]
    assert got == want
    m = r.metrics("L3").first()
    assert (m.source_rows, m.target_rows) == (len(source), len(target))


def rows_of(records):
    return Counter((x.k0, x.status, x.source_key_count, x.target_key_count, x.source_ordinal, x.target_ordinal, x.s and (x.s.name, x.s.n), x.t and (x.t.name, x.t.n)) for x in records.collect())


@pytest.mark.parametrize("hot_rows", [1, 40, 2000])
def test_a_key_of_half_of_all_rows_is_cut_into_pieces(spark, hot_rows):
    rng = random.Random(1)
    s = [("hot" if rng.random() < 0.5 else rng.choice("abcdefgh "), rng.choice(["x", None, "y"]), rng.randrange(50)) for _ in range(900)] + [(None, "z", 1)] * 30 + [("only", "s", 1)] * 50
    t = [("hot" if rng.random() < 0.5 else rng.choice("abcdefgk "), rng.choice(["x", None, "y"]), rng.randrange(50)) for _ in range(700)] + [("other", "t", 1)] * 60
    source, target = frame(spark, s).repartition(3), frame(spark, t).repartition(5)
    plain, cut = (rows_of(reconcile(source, target, ReconSpec(keys=SPEC.keys, hot_rows=h)).records) for h in (0, hot_rows))
    assert plain == cut and sum(n for row, n in cut.items() if row[:2] == ("hot", "MATCHED")) == max(sum(k == "hot" for k, *_ in side) for side in (s, t))
    assert sum(n for row, n in cut.items() if row[1] == "MISSING_IN_TARGET" and row[0] == "only") == 50


def test_keyless_rows_of_both_sides_never_meet(spark):
    same = frame(spark, [(None, "x", 1)] * 5 + [(" ", "y", 2)] * 3)
    got = Counter((x.status, x.s is None, x.t is None, x.source_key_count) for x in reconcile(same, same, SPEC).records.collect())
    assert got == {("UNMATCHABLE_SOURCE", False, True, None): 8, ("UNMATCHABLE_TARGET", True, False, None): 8}


def test_one_exchange_pairs_both_sides(spark):
    r = reconcile(frame(spark, SOURCE), frame(spark, TARGET), ReconSpec(keys=SPEC.keys, hot_rows=0)).records
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def grouped_by_key(records):
    """What duplicate_keys() gives, by grouping all rows of ``records``."""
    usable = records.filter("source_key_count IS NOT NULL").groupBy("k0")
    found = usable.agg(F.max("source_key_count").alias("s"), F.max("target_key_count").alias("t"), F.count_if(F.col("status") == "MATCHED").alias("n"))
    return Counter(map(str, found.filter("s > 1 OR t > 1").collect()))


@pytest.mark.parametrize("hot_rows", [0, 40])
def test_duplicate_keys_are_found_without_grouping(spark, hot_rows):
    s = [*SOURCE, *[("hot", "x", i % 3) for i in range(70)], ("b", "Beta", 1), ("c", None, None), ("", None, 1), ("", None, 1), (None, "Delta", 5)]
    t = [*TARGET, *[("hot", None, i % 5) for i in range(90)], *[("far", "x", 1)] * 45, ("d", "Delta", 6), ("e", "x", 1)]
    spec = ReconSpec(keys=SPEC.keys, hot_rows=hot_rows)
    for x, y in ((s, t), (t, s), (s, []), ([], t), (s, s)):
        found = reconcile(frame(spark, x), frame(spark, y), spec).records
        got = records.duplicate_keys(found)
        assert Counter(map(str, got.toDF("k0", "s", "t", "n").collect())) == grouped_by_key(found)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert hot_rows or plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan
    numbers = [(-0.0, "x", 1), (0.0, "x", 2), (float("nan"), "x", 1), (float("nan"), "y", 1), (1.5, "x", 1), (None, "x", 1), (None, "x", 1)]
    found = reconcile(*(frame(spark, x, "k double, name string, n int") for x in (numbers, numbers[:1])), spec).records
    assert Counter(map(str, records.duplicate_keys(found).toDF("k0", "s", "t", "n").collect())) == grouped_by_key(found) == {"Row(k0=0.0, s=2, t=1, n=2)": 1, "Row(k0=nan, s=2, t=0, n=0)": 1}


def test_numbers_take_one_window_and_values_a_second(spark):
    r = reconcile(frame(spark, SOURCE), frame(spark, TARGET), ReconSpec(keys=SPEC.keys, hot_rows=0)).records
    for rows, n in ((records.status_counts(r), 1), (records.record_metrics(r), 1), (records.duplicate_keys(r), 1), (r, 2)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window [") == n and plan.count("- Sort [") == n


@pytest.mark.parametrize("hot_rows", [0, 25])
def test_pairs_equal_those_made_by_hand(spark, hot_rows):
    """Columns of one type and of two, null values and keys, repeated rows, surplus on either side."""
    rng = random.Random(3)
    some = lambda n: [(rng.choice(["a", "b", "c", "d", "", None, "hot", "hot"]), rng.choice(["x", None, "y"]), rng.choice([None, 1, 2, 3])) for _ in range(n)]
    s, t = [("s", "only", 1)] * 3 + some(60), [("t", "only", 2)] * 2 + some(45)

    def numbered(rows):
        by_key = {}
        for k, *row in sorted(rows, key=lambda r: [(v is not None, v) for v in r]):
            if k:
                by_key.setdefault(k, []).append(tuple(row))
        return by_key

    a, b = numbered(s), numbered(t)
    want = Counter((None, f"UNMATCHABLE_{own}", None, None, None, None) for own, rows in (("SOURCE", s), ("TARGET", t)) for k, *_ in rows if not k)
    for k in {*a, *b}:
        x, y = a.get(k, []), b.get(k, [])
        for i in range(max(len(x), len(y))):
            m, n = i if i < len(x) else 0, i if i < len(y) else 0
            status = "MATCHED" if x and y else "MISSING_IN_TARGET" if x else "EXTRA_IN_TARGET"
            want[k, status, *((m + 1, x[m]) if x else (None, None)), *((n + 1, y[n]) if y else (None, None))] += 1
    for schema in (SCHEMA, "k string, name string, n double"):
        found = reconcile(frame(spark, s), frame(spark, [(k, v, n and (float(n) if "double" in schema else n)) for k, v, n in t], schema), ReconSpec(keys=SPEC.keys, hot_rows=hot_rows)).records
        got = Counter((r.k0, r.status, r.source_ordinal, r.s and (r.s.name, r.s.n), r.target_ordinal, r.t and (r.t.name, r.t.n)) if r.source_key_count is not None else (None, r.status, None, None, None, None) for r in found.collect())
        assert got == want


def test_a_dataset_agrees_with_itself_and_sides_swap(spark):
    good = frame(spark, [x for x in SOURCE if x[0] and x[0].strip()])
    r = reconcile(good, good, SPEC)
    assert {x.status for x in r.levels().collect()} == {"PASS"}
    a, b = (reconcile(frame(spark, x), frame(spark, y), SPEC).metrics("L3").first() for x, y in ((SOURCE, TARGET), (TARGET, SOURCE)))
    assert (a.missing, a.extra, a.unmatchable_source) == (b.extra, b.missing, b.unmatchable_target)


def test_more_tolerance_never_gives_more_mismatches(spark):
    counts = []
    for tolerance in (None, 0.5, 1.0, 10.0):
        spec = ReconSpec(keys=SPEC.keys, mappings=(Mapping("n", "n", tolerance=tolerance),))
        counts.append(reconcile(frame(spark, SOURCE), frame(spark, TARGET), spec).metrics("L4").first().mismatches)
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1]


def test_cells_normalise_and_compare(spark):
    s = frame(spark, [("1", "Ab ", 10), ("2", "", 20), ("3", None, None)])
    t = frame(spark, [("1", "aB", 11), ("2", None, 20), ("3", None, 5)])
    how = {"trim": True, "case_insensitive": True, "empty_as_null": True}
    rows = reconcile(s, t, ReconSpec(keys=SPEC.keys, mappings=(Mapping("name", "name", how),))).mismatches().collect()
    assert {(x.k0, x.source_column, x.source_value, x.target_value, x.difference) for x in rows} == {("1", "n", "10", "11", 1.0), ("3", "n", None, "5", None)}
    pattern = ReconSpec(keys=SPEC.keys, mappings=(Mapping("name", "name", comparison="REGEX", regex="(?i)^ab"), Mapping("n", "n", tolerance=10)))
    assert {x.k0 for x in reconcile(s, t, pattern).mismatches().collect()} == {"2", "3"}


def test_keys_of_different_types_meet_in_a_common_one(spark):
    s, t = frame(spark, [(1, "x")], "k long, v string"), frame(spark, [("1", "x"), ("y", "z")], "k string, v string")
    assert Counter(x.status for x in reconcile(s, t, SPEC).records.collect()) == {"MATCHED": 1, "EXTRA_IN_TARGET": 1}
    d = spark.sql("SELECT CAST(1.0 AS DECIMAL(3,1)) AS k, 'x' AS v")
    assert reconcile(s, d, SPEC).records.first().status == "MATCHED"
    assert reconcile(s, d, ReconSpec(keys=SPEC.keys, key_mode="text")).metrics("L3").first().matched_pairs == 0


def test_nested_values_dotted_names_and_empty_sides(spark):
    schema = "k int, `a.b` string, xs array<int>, m map<string,int>"
    s = frame(spark, [(1, "x", [1, 2], {"a": 1, "b": 2})], schema)
    t = frame(spark, [(1, "y", [1, 2], {"b": 2, "a": 1})], schema)
    assert [x.source_column for x in reconcile(s, t, SPEC).mismatches().collect()] == ["a.b"]
    nothing = frame(spark, [], schema)
    r = reconcile(nothing, nothing, SPEC)
    assert r.records.count() == 0 and r.metrics("L3").first().source_coverage_pct == 100.0
    assert r.metrics("L4").first().conformity_pct == 100.0
    assert r.metrics("L2").first().volume_coverage_pct == 100.0


def test_schema_drift(spark):
    s, t = frame(spark, [], "k int, a int, b string, c string"), frame(spark, [], "k int, a long, b2 string, d string")
    spec = ReconSpec(keys=SPEC.keys, mappings=(Mapping("b", "b2"),))
    assert {(x.column, x.target_column, x.drift) for x in schema_diff.schema_diff(s, t, spec).collect()} == {("a", "a", "DATA_TYPE_CHANGED"), ("c", "c", "MISSING_COLUMN"), (None, "d", "UNEXPECTED_COLUMN")}
    m = schema_diff.schema_metrics(s, t, spec).first()
    assert (m.matched, m.missing, m.source_coverage_pct, m.status) == (3, 1, 75.0, "FAIL")


def test_profiles(spark):
    row = profile.key_counts(frame(spark, SOURCE), ["k"]).first()
    assert (row.total_rows, row.keyed_rows, row.distinct_keys, row.duplicate_rows, row.unusable_rows) == (6, 4, 3, 1, 2)


def test_aggregates_with_tolerances_groups_and_missing_sides(spark):
    s = frame(spark, [("a", "x", 10), ("b", "x", 20), ("c", None, 5)])
    t = frame(spark, [("a", "x", 11), ("b", "x", 20), ("d", "y", 7)])
    rules = (
        AggregateRule("sum", "SUM", "n"), AggregateRule("sum5", "SUM", "n", tolerance_pct=10.0), AggregateRule("rows", "COUNT"), AggregateRule("off", "MAX", "n", enabled=False),
        AggregateRule("by", "AVG", "n", "n", ("name",), tolerance=0.5),
    )
    got = {(x.rule, tuple(x.group)): (x.source_value, x.target_value, x.matched) for x in aggregates.aggregate_checks(s, t, rules).collect()}
    assert got == {
        ("sum", ()): (35.0, 38.0, False), ("sum5", ()): (35.0, 38.0, True), ("rows", ()): (3.0, 3.0, True),
        ("by", ("x",)): (15.0, 15.5, True), ("by", (None,)): (5.0, None, False), ("by", ("y",)): (None, 7.0, False),
    }
    none = aggregates.aggregate_metrics(aggregates.aggregate_checks(s, t, ())).first()
    assert (none.checks_total, none.pass_rate_pct, none.status) == (0, 100.0, "PASS")


def test_quality_rules_on_nulls_and_text(spark):
    df = frame(spark, [("a@b", "1"), ("nope", "x"), (None, None), ("", "500")], "mail string, v string")
    rules = (
        QualityRule("mail", "PATTERN", "mail", apply_to="SOURCE", regex="@"), QualityRule("strict", "PATTERN", "mail", apply_to="SOURCE", regex="a@.", full_match=True, nulls_fail=True),
        QualityRule("there", "COMPLETENESS", "mail", "mail"), QualityRule("range", "VALIDITY", "v", apply_to="SOURCE", minimum=0, maximum=100), QualityRule("set", "VALIDITY", "v", apply_to="SOURCE", allowed=("1", "x")),
        QualityRule("absent", "COMPLETENESS", "other", apply_to="SOURCE"),
    )
    got = {(x.rule, x.side): x.failed for x in quality.quality_checks(df, df, rules).collect()}
    assert got == {("mail", "SOURCE"): 2, ("strict", "SOURCE"): 3, ("there", "SOURCE"): 2, ("there", "TARGET"): 2, ("range", "SOURCE"): 3, ("set", "SOURCE"): 1}


def test_group_fallback(spark):
    s = frame(spark, [(None, "E", 800), (None, "B", 1), ("g", "C", 2), ("z", "Q", 9)])
    t = frame(spark, [("e1", "e ", 810), ("e2", "E", 810), (None, "C", 2), ("b", "B", 1), ("y", "Q", 9)])
    how = {"trim": True, "case_insensitive": True}
    spec = ReconSpec(keys=SPEC.keys, groups=GroupSpec((Mapping("name", "name", how),), ((Mapping("n", "n"), "AVG"),)))
    r = reconcile(s, t, spec)
    assert {(x.n0, x.secondary_status) for x in groups.secondary_match(r.records, spec).collect()} == {("e", "MISSING_BUSINESS_KEY"), ("b", "MISSING_BUSINESS_KEY"), ("c", "MISSING_BUSINESS_KEY")}
    m = groups.group_summary(r.groups()).first()
    assert (m.common_groups, m.mismatch_groups, m.row_count_failed, m.duplicate_failed, m.values_failed, m.checks_total) == (3, 1, 1, 1, 1, 5)
    keyed = ReconSpec(keys=SPEC.keys, groups=spec.groups, detect_key_changes=True)
    assert ("q", "POSSIBLE_KEY_CHANGE") in {(x.n0, x.secondary_status) for x in groups.secondary_match(r.records, keyed).collect()}


def test_mode_breaks_ties_by_text_and_keeps_null_groups(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), (None, "z"), (None, "z"), (None, None)], "g string, v string")
    assert {(x.g, x["mode"]) for x in groups.mode(df, ["g"], "v").collect()} == {("g", "a"), (None, "z")}
    both = groups.group_recon(df, df, GroupSpec((Mapping("g", "g"),), ((Mapping("v", "v"), "MODE"),)))
    assert {(x.g0, x.s_a0) for x in both.collect()} == {("g", "a"), (None, "z")}


def test_row_hash_tells_where_a_value_ends(spark):
    df = spark.createDataFrame([("a\x1f1b", "c"), ("a", "b\x1f1c"), ("11:a", ""), ("1", "1:a"), (None, "0"), ("0", None)], "v string, w string")
    assert df.select(fields.row_hash(df, [("v", {}), ("w", {})]).alias("h")).distinct().count() == 6


def test_large_numbers_are_subtracted_exactly(spark):
    s, t = frame(spark, [("a", 2**53), ("b", 5)], "k string, n long"), frame(spark, [("a", 2**53 + 1), ("b", 5)], "k string, n long")
    for tolerance, keys in ((0, {"a"}), (1, set())):
        spec = ReconSpec(keys=SPEC.keys, mappings=(Mapping("n", "n", tolerance=tolerance),))
        assert {x.k0 for x in reconcile(s, t, spec).mismatches().collect()} == keys
    assert reconcile(s, t, SPEC).mismatches().first().difference == 1.0
    sums = aggregates.aggregate_checks(s, t, (AggregateRule("n", "SUM", "n"), AggregateRule("max", "MAX", "n", tolerance=0), AggregateRule("near", "SUM", "n", tolerance={"absolute": 1})))
    assert {(x.rule, x.difference, x.matched) for x in sums.collect()} == {("n", 1.0, False), ("max", 1.0, False), ("near", 1.0, True)}
    d = spark.sql("SELECT 'a' AS k, CAST('99999999999999999999999999999999999999' AS DECIMAL(38,0)) AS n")
    assert reconcile(d, d, ReconSpec(keys=SPEC.keys, mappings=(Mapping("n", "n", tolerance=0),))).metrics("L4").first().status == "PASS"


def test_two_modes_and_other_aggregates_of_a_group(spark):
    s = frame(spark, [("a", "x", 1), ("a", "x", 2), ("a", "y", 2), ("b", None, None), (None, "z", 3)])
    t = frame(spark, [("a", "x", 1), ("a", "x", 2), ("a", "z", 2), ("b", "q", None), (None, "z", 4)])
    pairs = ((Mapping("name", "name"), "MODE"), (Mapping("n", "n"), "MODE"), (Mapping("n", "n"), "AVG"), (Mapping("n", "n"), "COUNT"), (Mapping("name", "name"), "MAX"))
    found = groups.group_recon(s, t, GroupSpec((Mapping("k", "k"),), pairs))
    got = {x.g0: tuple(x[f"{side}_a{i}"] for side in "st" for i in range(5)) for x in found.collect()}
    assert got == {"a": ("x", 2, 5 / 3, "3", "y", "x", 2, 5 / 3, "3", "z"), "b": (None, None, None, "0", None, "q", None, None, "0", "q"), None: ("z", 3, 3.0, "1", "z", "z", 4, 4.0, "1", "z")}
    rows = {(x.g0, x.check_name): x.status for x in groups.evidence_rows(found, GroupSpec((Mapping("k", "k"),), pairs)).collect()}
    assert rows["a", "MAX(name)"] == "FAIL" and rows["a", "DUPLICATE_ROWS"] == "FAIL" and rows["b", "COUNT(n)"] == "PASS" and ("b", "AVG(n)") not in rows


def test_row_hash_tells_null_from_its_name(spark):
    df = spark.createDataFrame([("0",), (None,), ("1",), ("",)], "v string")
    assert df.select(fields.row_hash(df, [("v", {})]).alias("h")).distinct().count() == 4


def test_text_that_is_no_number_does_not_break_a_filter(spark):
    df = frame(spark, [("1", "x", 1), ("nope", "y", 2), (None, "z", 3), ("12", "w", 4)])
    assert [x.k for x in apply_filters(df, (RowFilter("k", ">", 5),)).collect()] == ["12"]
    assert {x.k for x in apply_filters(df, (RowFilter("k", "IN", [1, 2]),)).collect()} == {"1"}
    assert {x.k for x in apply_filters(df, (RowFilter("k", "!=", "1"),), null_is_unequal=True).collect()} == {"nope", None, "12"}


def test_edges(spark):
    results = spark.createDataFrame([("r", "t", 1, "old"), ("r", "t", 2, "new"), ("r", "u", 1, "x")], "run_id string, task_id string, created_at int, status string")
    tasks = spark.createDataFrame([("r", "t", "SUCCESS"), ("r", "u", "FAILED")], "run_id string, task_id string, state string")
    assert [x.status for x in latest_results(results, tasks).collect()] == ["new"]
    with pytest.raises(SpecError):
        reconcile(frame(spark, SOURCE), frame(spark, TARGET), ReconSpec(keys=(("q", "q"),)))
    assert records.sample_by_key(frame(spark, SOURCE), ["k"], 100).count() == len(SOURCE)


def test_transformation_pairs_duplicate_keys_by_ordinal(spark):
    source = spark.createDataFrame([(1, "a")] * 3 + [(1, "b"), (2, "c"), (None, "d"), (7, "z")], "k int, v string")
    target = spark.createDataFrame([(1, "A")] * 3 + [(1, "B"), (2, "x"), (None, "D"), (None, "E")], "k int, v string")
    got = quality.transformation(source, target, [("k", "k")], "v", "v", "UPPER").first()
    assert (got.pairs, got.failed, got.unmatchable_source, got.unmatchable_target) == (5, 1, 1, 2)


def test_group_sums_do_not_depend_on_the_order_of_rows(spark):
    pairs = ((Mapping("v", "v"), "SUM"), (Mapping("v", "v"), "AVG"))
    values = ["0.10", "0.20", "0.30", "12345678901.27", "-12345678901.27"]
    for cast, failed in (("decimal(18,2)", False), ("double", False)):
        s = spark.createDataFrame([("g", x) for x in values], "k string, v string").withColumn("v", F.col("v").cast(cast))
        t = spark.createDataFrame([("g", x) for x in reversed(values)], "k string, v string").withColumn("v", F.col("v").cast(cast)).repartition(5)
        row = groups.group_recon(s, t, GroupSpec((Mapping("k", "k"),), pairs)).first()
        assert row.value_failed is failed, cast
    cents = spark.createDataFrame([("g", "0.01")], "k string, v string").select("k", F.col("v").cast("decimal(38,2)").alias("v"))
    large = spark.createDataFrame([("g", "99999999999999999999999.00")], "k string, v string").select("k", F.col("v").cast("decimal(38,2)").alias("v"))
    assert groups.group_recon(large, large.unionByName(cents), GroupSpec((Mapping("k", "k"),), pairs[:1])).first().value_failed


def test_filters_on_text_compare_whole_and_decimal_numbers_exactly(spark):
    df = spark.createDataFrame([("9007199254740993",), ("9007199254740992",), ("0.1",), ("0.10000000000000001",), ("1e3",), ("1" + "0" * 30,), ("nope",), (None,), (" 7 ",)], "k string")
    kept = lambda *f, **how: {x.k for x in apply_filters(df, (RowFilter("k", *f),), **how).collect()}
    assert kept("=", 9007199254740992) == {"9007199254740992"}
    assert kept("IN", [9007199254740993, 1000]) == {"9007199254740993", "1e3"}
    assert kept("=", Decimal("0.1")) == {"0.1"} and kept("=", 0.1) == {"0.1", "0.10000000000000001"}
    assert kept(">", 10**20) == {"1" + "0" * 30} and " 7 " in kept("<=", 7)
    assert kept("!=", 7, null_is_unequal=True) == {x.k for x in df.collect()} - {" 7 "}


def test_pieces_of_rows_behind_a_shuffle(spark):
    """Rows that come in another order whenever they are read again still pair once."""
    s = spark.range(4000).select(F.lit(1).alias("k"), (F.col("id") % 3).alias("v")).repartition(7)
    t = spark.range(3000).select(F.lit(1).alias("k"), (F.col("id") % 3).alias("v")).repartition(3)
    found = records.reconcile_records(s, t, ReconSpec(keys=(("k", "k"),), hot_rows=1))
    row = found.agg(F.count("*").alias("n"), F.count_distinct("source_ordinal").alias("s"), F.count_distinct("target_ordinal").alias("t"), F.max("source_ordinal").alias("last")).first()
    assert (row.n, row.s, row.t, row.last) == (4000, 4000, 3000, 4000)


def test_distributions_of_numbers(spark):
    rng = random.Random(5)
    s = spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(3000)] + [(None,), (float("nan"),)], "x double")
    t = spark.createDataFrame([(rng.gauss(0.8, 1),) for _ in range(2000)], "y double")
    borders = quality.quantile_borders(s, t, "x", "y", 8)
    assert len(borders) == 7 and borders == sorted(borders)
    bins = quality.numeric_distribution(s, t, "x", "y", borders).collect()
    assert len(bins) == 9 and sum(b.source_rows for b in bins) == 3002 and sum(b.target_rows for b in bins) == 2000
    assert all(abs(b.source_rows + b.target_rows - 625) < 5 for b in bins if b.bin >= 0) and next(b for b in bins if b.bin == -1).source_rows == 2
    far = quality.distribution_shift(quality.numeric_distribution(s, t, "x", "y", borders)).first()
    same = quality.distribution_shift(quality.numeric_distribution(s, s, "x", "x", borders)).first()
    assert far.psi > 0.4 and 0.25 < far.ks < 0.4 and not far.matched and same.matched and same.psi == same.ks == same.null_difference == 0
    none = quality.distribution_shift(quality.numeric_distribution(s, t.limit(0), "x", "y", borders)).first()
    assert none.psi is None and not none.matched
    whole = quality.numeric_distribution(spark.range(10), spark.range(5, 15), "id", "id", [5.0]).orderBy("bin").collect()
    assert [(b.bin, b.source_rows, b.target_rows) for b in whole] == [(-1, 0, 0), (0, 5, 0), (1, 5, 10)] and whole[2].ks == 0 and whole[1].psi > 0
    with pytest.raises(SpecError):
        quality.numeric_distribution(s, t, "x", "y", [2.0, 1.0])


def test_sums_of_doubles_agree_whatever_the_order_of_rows(spark):
    values = [0.1, 0.2, 0.3, 1e9, 0.7] * 50
    s = spark.createDataFrame([(x,) for x in values], "v double").repartition(3)
    t = spark.createDataFrame([(x,) for x in reversed(sorted(values))], "v double").repartition(7)
    rules = (AggregateRule("sum", "SUM", "v"), AggregateRule("avg", "AVG", "v"), AggregateRule("max", "MAX", "v"))
    assert all(r.matched for r in aggregates.aggregate_checks(s, t, rules).collect())
    more = t.unionByName(spark.createDataFrame([(1e6,)], "v double"))
    assert {r.rule: r.matched for r in aggregates.aggregate_checks(s, more, rules).collect()} == {"sum": False, "avg": False, "max": True}


def test_a_frequent_key_in_a_tiny_file_is_found(spark, tmp_path):
    """200,000 equal keys take a few bytes in Parquet; they are cut into pieces all the same."""
    rows = spark.range(200_000).select(F.when(F.col("id") < 180_000, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 5).cast("int").alias("v"))
    rows.sort("k").coalesce(1).write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    found = records.frequent_keys([(s, [F.col("k")], ["k"]), (s, [F.col("k")], ["k"])], 50_000, 0.02)
    assert [r.k0 for r in found.collect()] == [7]
    assert records.frequent_keys([(s.filter("k != 7"), [F.col("k")], ["k"]), (s.limit(0), [F.col("k")], ["k"])], 50_000, 0.02) is None
    spec = ReconSpec(keys=(("k", "k"),), hot_rows=50_000)
    got = reconcile(s, s.filter("v != 1"), spec).records.groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"MATCHED": 180_000 + 16_000, "MISSING_IN_TARGET": 4000}


def test_a_sample_without_a_usable_key_still_counts_its_rows(spark):
    keyless, empty = frame(spark, [(None, "x", 1)] * 20 + [(" ", "y", 2)] * 5), frame(spark, [])
    for s, t, n in ((keyless, keyless, 50), (keyless, empty, 25), (empty, empty, 0)):
        seen = {}
        assert records.frequent_keys([(s, [F.col("k")], ["k"]), (t, [F.col("k")], ["k"])], 10, 1.0, seen) is None and seen == {"n": n}
        for hot_rows in (10, 1_000_000):
            assert reconcile(s, t, ReconSpec(keys=SPEC.keys, hot_rows=hot_rows)).records.count() == n


def test_rows_of_a_task_do_not_grow_with_the_tables(spark, monkeypatch):
    monkeypatch.setattr(records, "TASK_ROWS", 100, raising=False)
    s = spark.range(3000).select(F.col("id").alias("k"))
    found = records.reconcile_records(s, s, ReconSpec(keys=(("k", "k"),), hot_rows=1000))
    sizes = [r.n for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and len(sizes) > 30 and max(sizes) < 200


def test_a_scan_does_not_sort_what_it_writes_up_to_150_million_rows():
    """Spark's scan gathers and sorts its rows once they go to more than 200 tasks."""
    million = 1_000_000
    found = [records.tasks_of(n * million) for n in (1, 18, 49, 55, 109, 149, 400)]
    assert found == [None, 73, 197, 200, 200, 200, 1601]
