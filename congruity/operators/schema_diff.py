"""Level 1: columns, types and nullability. Metadata only; no rows are read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..spec import ReconSpec

SCHEMA = "column string, target_column string, drift string, source_type string, target_type string"


def drifts(source: DataFrame, target: DataFrame, spec: ReconSpec) -> list[tuple]:
    there, found = {f.name: f for f in target.schema.fields}, []
    mine = [f for f in source.schema.fields if f.name not in spec.ignore_source]
    for f in mine:
        g = there.get(name := spec.target_of(f.name))
        if g is None or name in spec.ignore_target:
            found.append((f.name, name, "MISSING_COLUMN", f.dataType.simpleString(), None))
            continue
        if f.dataType != g.dataType:
            found.append((f.name, name, "DATA_TYPE_CHANGED", f.dataType.simpleString(), g.dataType.simpleString()))
        if f.nullable != g.nullable:
            found.append((f.name, name, "NULLABILITY_CHANGED", str(f.nullable).lower(), str(g.nullable).lower()))
    known = {spec.target_of(f.name) for f in mine} | {f.name for f in source.schema.fields}
    found += [(None, g.name, "UNEXPECTED_COLUMN", None, g.dataType.simpleString()) for g in target.schema.fields if g.name not in known and g.name not in spec.ignore_target]
    return found


def schema_diff(source: DataFrame, target: DataFrame, spec: ReconSpec) -> DataFrame:
    """One row per drift; none means that the level passes."""
    return source.sparkSession.createDataFrame(drifts(source, target, spec), SCHEMA)


def schema_metrics(source: DataFrame, target: DataFrame, spec: ReconSpec) -> DataFrame:
    found = drifts(source, target, spec)
    n = {k: sum(x[2] == k for x in found) for k in ("MISSING_COLUMN", "UNEXPECTED_COLUMN", "DATA_TYPE_CHANGED", "NULLABILITY_CHANGED")}
    mine = [c for c in source.columns if c not in spec.ignore_source]
    theirs = [c for c in target.columns if c not in spec.ignore_target]
    matched = len(mine) - n["MISSING_COLUMN"]

    def rate(d: int) -> float:
        return round(matched / d * 100, 2) if d else 100.0

    row = (len(mine), len(theirs), matched, *n.values(), rate(len(mine)), rate(len(theirs)), "FAIL" if found else "PASS")
    return source.sparkSession.createDataFrame(
        [row], "source_columns long, target_columns long, matched long, missing long, unexpected long, type_changed long, nullability_changed long, source_coverage_pct double, target_coverage_pct double, status string"
    )
