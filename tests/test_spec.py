import pytest

from congruity.spec import AggregateRule, GroupSpec, Mapping, QualityRule, ReconSpec, RowFilter, SpecError


@pytest.mark.parametrize(
    "make",
    [
        lambda: RowFilter("a", "LIKE", "x"),
        lambda: RowFilter("a", "IN", []),
        lambda: RowFilter("a", "IS NULL", 1),
        lambda: RowFilter("a", "="),
        lambda: Mapping("a", "a", {"squash": True}),
        lambda: Mapping("a", "a", {"round": -1}),
        lambda: Mapping("a", "a", tolerance=-1),
        lambda: Mapping("a", "a", tolerance_pct=101),
        lambda: Mapping("a", "a", comparison="REGEX", regex="("),
        lambda: AggregateRule("r", "SUM"),
        lambda: AggregateRule("r", "MEDIAN", "a"),
        lambda: AggregateRule("r", "SUM", "a", "a", ("g",), ("g", "h")),
        lambda: QualityRule("r", "PATTERN", "a", "a"),
        lambda: QualityRule("r", "COMPLETENESS", "a"),
        lambda: QualityRule("r", "VALIDITY", "a", "a"),
        lambda: GroupSpec((), ((Mapping("a", "a"), "SUM"),)),
        lambda: GroupSpec((Mapping("a", "a"),), ()),
        lambda: ReconSpec(levels=()),
        lambda: ReconSpec(levels=("L4",)),
        lambda: ReconSpec(keys=(("a", "b"),), mappings=(Mapping("a", "b"),), ignore_target=frozenset("b")),
    ],
)
def test_what_cannot_run_is_refused(make):
    with pytest.raises(SpecError):
        make()


def test_defaults_follow_from_what_is_given():
    assert Mapping("a", "b", tolerance=1).comparison == "NUMERIC_TOLERANCE"
    assert Mapping("a", "b", tolerance=1, tolerance_pct=2).comparison == "PERCENTAGE_TOLERANCE"
    assert Mapping("a", "b", {"trim": True, "round": None, "case_insensitive": False}).normalization == {"trim": True}
    assert RowFilter("a", "is_not_null").operator == "IS NOT NULL"
    assert RowFilter("a", "in", 3).value == (3,)


def test_ignoring_one_side_of_a_mapping_ignores_both():
    spec = ReconSpec(keys=(("k", "k"),), mappings=(Mapping("a", "b"),), ignore_source=frozenset("a"))
    assert spec.ignore_target == {"b"}
    assert [m.source for m in spec.pairs(["k", "a", "c", "d"], ["k", "b", "c"])] == ["c"]


@pytest.mark.parametrize(
    "part",
    [
        {"mappings": (Mapping("a", "typo"),)},
        {"mappings": (Mapping("typo", "a"),)},
        {"source_filters": (RowFilter("typo", "=", 1),)},
        {"aggregates": (AggregateRule("r", "SUM", "a", "typo"),)},
        {"aggregates": (AggregateRule("r", "COUNT", source_group_by=("typo",)),)},
        {"quality": (QualityRule("r", "COMPLETENESS", "a", "typo"),)},
        {"groups": GroupSpec((Mapping("a", "a"),), ((Mapping("a", "typo"), "SUM"),))},
        {"keys": (("k", "typo"),)},
    ],
)
def test_named_columns_must_exist(part):
    with pytest.raises(SpecError):
        ReconSpec(**{"keys": (("k", "k"),)} | part).check(["k", "a"], ["k", "a"])


def test_what_is_off_or_ignored_need_not_exist():
    ReconSpec(
        keys=(("k", "k"),), mappings=(Mapping("gone", "a"),), ignore_source=frozenset(("gone",)),
        aggregates=(AggregateRule("r", "SUM", "typo", enabled=False),), quality=(QualityRule("r", "COMPLETENESS", "a", apply_to="SOURCE"),),
    ).check(["k", "a"], ["k", "a"])


def test_specifications_are_read_back_from_json():
    spec = ReconSpec(
        keys=(("k", "id"),), mappings=(Mapping("a", "b", {"trim": True}, tolerance=1.5),), ignore_target=frozenset(("x", "y")), source_filters=(RowFilter("a", "in", ["1", "2"]),),
        aggregates=(AggregateRule("r", "SUM", "a", "b", ("g",), tolerance={"absolute": 1.0, "percentage": 2.0}),), quality=(QualityRule("q", "VALIDITY", "a", "b", allowed=("u", "v")),),
        groups=GroupSpec((Mapping("g", "g"),), ((Mapping("a", "b"), "MODE"),)), levels=("L1", "L3"), detect_key_changes=True,
    )
    assert ReconSpec.from_json(spec.to_json()) == spec and ReconSpec.from_json("{}") == ReconSpec()
    for bad in ('{"key": []}', '{"mappings": [{"source": "a", "target": "b", "tolerence": 1}]}', "[]", '{"levels": ["L9"]}'):
        with pytest.raises(SpecError):
            ReconSpec.from_json(bad)


def test_tolerances_by_name():
    with pytest.raises(SpecError):
        AggregateRule("r", "COUNT", tolerance={"relative": 1})
    with pytest.raises(SpecError):
        QualityRule("r", "COMPLETENESS", "a", "a", tolerance={"absolute": -1})
