"""What to compare and how: plain frozen dataclasses, checked when they are made."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields
from typing import Any

#: The words a specification may use.
NORMALIZATIONS = frozenset(("trim", "case_insensitive", "empty_as_null", "round"))
COMPARISONS = frozenset(("EXACT", "NUMERIC_TOLERANCE", "PERCENTAGE_TOLERANCE", "REGEX"))
OPERATORS = frozenset(("=", "!=", ">", ">=", "<", "<=", "IN", "IS NULL", "IS NOT NULL"))
AGGREGATES = frozenset(("SUM", "AVG", "MIN", "MAX", "COUNT", "MODE"))
SIDES = frozenset(("SOURCE", "TARGET", "BOTH"))
QUALITY_RULES = frozenset(("PATTERN", "COMPLETENESS", "VALIDITY"))
LEVELS = ("L1", "L2", "L3", "L4", "L5", "L6")


class SpecError(ValueError):
    """A specification that cannot be run."""


def require(ok: object, message: str) -> None:
    if not ok:
        raise SpecError(message)


#: A number, or "absolute" and "percentage" by name.
Tolerance = float | dict[str, float] | None


def check_tolerances(tolerance: Tolerance, tolerance_pct: float | None) -> None:
    named = tolerance if isinstance(tolerance, dict) else {"absolute": tolerance}
    require(named.keys() <= {"absolute", "percentage"}, "a tolerance is absolute or percentage")
    require(all(x is None or x >= 0 for x in named.values()), "tolerance must not be negative")
    require(tolerance_pct is None or 0 <= tolerance_pct <= 100, "tolerance_pct must be from 0 to 100")


def limits(tolerance: Tolerance, tolerance_pct: float | None = None) -> tuple[float | None, float | None]:
    """The absolute limit and that in per cent; tolerance_pct goes before all others."""
    if tolerance_pct is not None:
        return None, tolerance_pct
    if isinstance(tolerance, dict):
        return tolerance.get("absolute"), tolerance.get("percentage")
    return tolerance, None


@dataclass(frozen=True)
class RowFilter:
    """One predicate; all filters of a side hold together."""

    field: str
    operator: str
    value: Any = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "operator", " ".join(self.operator.upper().replace("_", " ").split()))
        require(self.operator in OPERATORS, f"unknown operator {self.operator}")
        if self.operator in ("IS NULL", "IS NOT NULL"):
            require(self.value is None, f"{self.operator} takes no value")
        elif self.operator == "IN":
            values = self.value if isinstance(self.value, (list, tuple)) else [self.value]
            require(len(values) and self.value is not None, "IN needs a list of values")
            object.__setattr__(self, "value", tuple(values))
        else:
            require(self.value is not None, f"{self.operator} needs a value")


@dataclass(frozen=True)
class Mapping:
    """A source column, its target column, and how their values are compared."""

    source: str
    target: str
    normalization: dict[str, Any] = field(default_factory=dict)
    comparison: str = ""
    tolerance: float | None = None
    tolerance_pct: float | None = None
    regex: str | None = None

    def __post_init__(self) -> None:
        kept = {k: v for k, v in self.normalization.items() if v is not None and v is not False}
        require(kept.keys() <= NORMALIZATIONS, f"unknown normalization {sorted(kept.keys() - NORMALIZATIONS)}")
        if "round" in kept:
            require(isinstance(kept["round"], int) and not isinstance(kept["round"], bool) and kept["round"] >= 0, "round must be a whole number of digits")
        object.__setattr__(self, "normalization", kept)
        check_tolerances(self.tolerance, self.tolerance_pct)
        default = "PERCENTAGE_TOLERANCE" if self.tolerance_pct is not None else "NUMERIC_TOLERANCE" if self.tolerance is not None else "EXACT"
        object.__setattr__(self, "comparison", self.comparison.upper() or default)
        require(self.comparison in COMPARISONS, f"unknown comparison {self.comparison}")
        if self.comparison == "REGEX":
            require(self.regex, "REGEX needs a pattern")
            try:
                re.compile(self.regex)
            except re.error as e:
                raise SpecError(f"bad pattern: {e}") from e


@dataclass(frozen=True)
class AggregateRule:
    """One aggregate that both sides must agree on, over all rows or by groups."""

    name: str
    function: str
    source_column: str | None = None
    target_column: str | None = None
    source_group_by: tuple[str, ...] = ()
    target_group_by: tuple[str, ...] = ()
    tolerance: Tolerance = None
    tolerance_pct: float | None = None
    enabled: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "function", self.function.upper())
        object.__setattr__(self, "source_group_by", tuple(self.source_group_by))
        object.__setattr__(self, "target_group_by", tuple(self.target_group_by) or self.source_group_by)
        object.__setattr__(self, "target_column", self.target_column or self.source_column)
        require(self.function in AGGREGATES - {"MODE"}, f"unknown aggregate {self.function}")
        require(self.source_column or self.function == "COUNT", f"{self.function} needs a column")
        require(len(self.source_group_by) == len(self.target_group_by), "both sides need as many grouping columns")
        check_tolerances(self.tolerance, self.tolerance_pct)


@dataclass(frozen=True)
class QualityRule:
    """PATTERN, COMPLETENESS or VALIDITY of one column on one side or both."""

    name: str
    rule: str
    source_column: str | None = None
    target_column: str | None = None
    apply_to: str = "BOTH"
    regex: str | None = None
    full_match: bool = False
    nulls_fail: bool = False
    allowed: tuple[Any, ...] = ()
    minimum: float | None = None
    maximum: float | None = None
    tolerance: Tolerance = None
    enabled: bool = True

    def __post_init__(self) -> None:
        check_tolerances(self.tolerance, None)
        object.__setattr__(self, "rule", self.rule.upper())
        object.__setattr__(self, "apply_to", self.apply_to.upper())
        object.__setattr__(self, "allowed", tuple(self.allowed))
        require(self.rule in QUALITY_RULES, f"unknown rule {self.rule}")
        require(self.apply_to in SIDES, f"unknown side {self.apply_to}")
        require(self.rule != "PATTERN" or self.regex, "PATTERN needs a regex")
        require(self.rule != "VALIDITY" or self.allowed or self.minimum is not None or self.maximum is not None, "VALIDITY needs allowed values or bounds")
        require(self.apply_to == "TARGET" or self.source_column, "the rule needs a source column")
        require(self.apply_to == "SOURCE" or self.target_column, "the rule needs a target column")


@dataclass(frozen=True)
class GroupSpec:
    """Attributes that stand in for missing keys, and what groups must agree on."""

    grouping: tuple[Mapping, ...]
    aggregations: tuple[tuple[Mapping, str], ...]

    def __post_init__(self) -> None:
        require(self.grouping, "group reconciliation needs a grouping pair")
        require(self.aggregations, "group reconciliation needs an aggregation pair")
        require(all(op in AGGREGATES for _, op in self.aggregations), "unknown aggregate")


@dataclass(frozen=True)
class ReconSpec:
    """A whole comparison."""

    keys: tuple[tuple[str, str], ...] = ()
    mappings: tuple[Mapping, ...] = ()
    ignore_source: frozenset[str] = frozenset()
    ignore_target: frozenset[str] = frozenset()
    source_filters: tuple[RowFilter, ...] = ()
    target_filters: tuple[RowFilter, ...] = ()
    aggregates: tuple[AggregateRule, ...] = ()
    quality: tuple[QualityRule, ...] = ()
    groups: GroupSpec | None = None
    levels: tuple[str, ...] = LEVELS
    pair_order: str = "aligned"
    key_mode: str = "common"
    detect_key_changes: bool = False
    #: Rows from which a key is cut into pieces; 0 where no key can be that frequent.
    hot_rows: int = 1_000_000

    def __post_init__(self) -> None:
        require(self.levels and set(self.levels) <= set(LEVELS), f"levels must be among {LEVELS}")
        require("L4" not in self.levels or "L3" in self.levels, "L4 needs L3")
        require(self.pair_order in ("aligned", "own"), "pair_order is aligned or own")
        require(self.key_mode in ("common", "text"), "key_mode is common or text")
        source, target = set(self.ignore_source), set(self.ignore_target)
        moved = True
        while moved:  # a mapping of an ignored column is ignored on both sides
            moved = False
            for m in self.mappings:
                if (m.source in source) != (m.target in target):
                    source.add(m.source)
                    target.add(m.target)
                    moved = True
        object.__setattr__(self, "ignore_source", frozenset(source))
        object.__setattr__(self, "ignore_target", frozenset(target))
        used = [("key", s, t) for s, t in self.keys]
        if self.groups:
            used += [("grouping column", m.source, m.target) for m in self.groups.grouping] + [("aggregated column", m.source, m.target) for m, _ in self.groups.aggregations]
        for what, s, t in used:
            require(s not in source and t not in target, f"{what} {s} is ignored")

    def target_of(self, source: str) -> str:
        named = {m.source: m.target for m in self.mappings} | dict(self.keys)
        return named.get(source, source)

    def pairs(self, source_columns: list[str], target_columns: list[str]) -> list[Mapping]:
        """The columns to compare: all of the source but keys and ignored ones, that
        have a mapped or equally named column in the target."""
        explicit, keys = {m.source: m for m in self.mappings}, {s for s, _ in self.keys}
        out = []
        for c in source_columns:
            m = explicit.get(c) or Mapping(c, c)
            if c not in keys and c not in self.ignore_source and m.target in target_columns and m.target not in self.ignore_target:
                out.append(m)
        return out

    def check(self, source_columns: list[str], target_columns: list[str]) -> None:
        """Whether all columns it names exist."""
        groups = [*self.groups.grouping, *(m for m, _ in self.groups.aggregations)] if self.groups else []
        mapped = [m for m in self.mappings if m.source not in self.ignore_source]
        aggregates, quality = [r for r in self.aggregates if r.enabled], [r for r in self.quality if r.enabled]
        source = [s for s, _ in self.keys] + [f.field for f in self.source_filters] + [m.source for m in (*mapped, *groups)]
        target = [t for _, t in self.keys] + [f.field for f in self.target_filters] + [m.target for m in (*mapped, *groups)]
        for r in aggregates:
            source += [*r.source_group_by, *([r.source_column] if r.source_column else [])]
            target += [*r.target_group_by, *([r.target_column] if r.target_column else [])]
        source += [r.source_column for r in quality if r.apply_to != "TARGET"]
        target += [r.target_column for r in quality if r.apply_to != "SOURCE"]
        for side, columns, names in (("source", source_columns, source), ("target", target_columns, target)):
            for n in names:
                require(n in columns, f"no column {n} in the {side}")

    def to_json(self) -> str:
        """The whole specification as text; ``from_json`` reads it back."""
        return json.dumps(asdict(self), default=lambda x: sorted(x) if isinstance(x, frozenset) else str(x), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> ReconSpec:
        """A specification from text; unknown names are refused."""
        p = json.loads(text)
        require(isinstance(p, dict), "a specification is an object")

        def made(kind: type, rows: list[dict]) -> tuple:
            known = {f.name for f in fields(kind)}
            for r in rows:
                require(set(r) <= known, f"unknown names {sorted(set(r) - known)}")
            return tuple(kind(**r) for r in rows)

        require(set(p) <= {f.name for f in fields(cls)}, f"unknown names {sorted(set(p) - {f.name for f in fields(cls)})}")
        p["keys"] = tuple(tuple(k) for k in p.get("keys", ()))
        p |= {n: frozenset(p.get(n, ())) for n in ("ignore_source", "ignore_target")}
        p |= {n: made(kind, p.get(n, [])) for n, kind in (("mappings", Mapping), ("source_filters", RowFilter), ("target_filters", RowFilter), ("aggregates", AggregateRule), ("quality", QualityRule))}
        if p.get("groups"):
            g = p["groups"]
            p["groups"] = GroupSpec(made(Mapping, g.get("grouping", [])), tuple((made(Mapping, [m])[0], op) for m, op in g.get("aggregations", [])))
        if "levels" in p:
            p["levels"] = tuple(p["levels"])
        return cls(**p)
