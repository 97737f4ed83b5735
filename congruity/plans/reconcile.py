"""A whole run: every level a lazy DataFrame."""

from __future__ import annotations

from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, correlate, fields, groups, profile, quality, records, sampling, schema_diff
from ..operators.filters import apply_filters
from ..spec import ReconSpec


class Reconciliation:
    """Two datasets and a specification. Nothing runs before an action."""

    def __init__(self, source: DataFrame, target: DataFrame, spec: ReconSpec):
        spec.check(source.columns, target.columns)
        self.spec = spec
        self.source, self.target = apply_filters(source, spec.source_filters), apply_filters(target, spec.target_filters)

    @cached_property
    def records(self) -> DataFrame:
        return records.reconcile_records(self.source, self.target, self.spec)

    @contextmanager
    def cached_records(self):
        """Keeps the pairs for the levels that read them several times."""
        self.records.persist()
        try:
            yield self
        finally:
            self.records.unpersist()

    def pairs(self):
        return self.spec.pairs(self.source.columns, self.target.columns)

    def schema(self) -> DataFrame:
        return schema_diff.schema_diff(self.source, self.target, self.spec)

    def volume(self) -> DataFrame:
        return profile.volume_checks(self.source, self.target, self.spec)

    def mismatches(self) -> DataFrame:
        return fields.field_mismatches(self.records, self.pairs(), len(self.spec.keys))

    def field_stats(self) -> DataFrame:
        return fields.field_stats(self.records, self.pairs())

    def aggregates(self) -> DataFrame:
        return aggregates.aggregate_checks(self.source, self.target, self.spec.aggregates)

    def quality(self) -> DataFrame:
        return quality.quality_checks(self.source, self.target, self.spec.quality)

    def groups(self) -> DataFrame:
        if self.spec.keys:
            return groups.fallback_groups(self.records, self.spec)
        return groups.group_recon(self.source, self.target, self.spec.groups)

    def metrics(self, level: str) -> DataFrame:
        """One row with a status."""
        if level in ("L3", "L4") and not self.spec.keys:
            if level == "L3" and self.spec.groups:
                return groups.group_summary(self.groups())
            return self.source.sparkSession.createDataFrame([("NOT_APPLICABLE",)], "status string")
        return {
            "L1": lambda: schema_diff.schema_metrics(self.source, self.target, self.spec),
            "L2": lambda: profile.volume_metrics(self.source, self.target, self.spec),
            "L3": lambda: records.record_metrics(self.records),
            "L4": lambda: fields.field_metrics(self.records, self.pairs(), len(self.spec.keys)),
            "L5": lambda: aggregates.aggregate_metrics(self.aggregates()),
            "L6": lambda: quality.quality_metrics(self.quality()),
        }[level]()

    def sampled(self, rows: int, strata: tuple[str, ...] = (), seed: int = 0, confidence: float = 0.95) -> DataFrame:
        """Coverage, mismatches and extra rows with their bounds, from about ``rows`` rows
        of each stratum."""
        return sampling.sampled_metrics(self.source, self.target, self.spec, rows, strata, seed, confidence)

    def levels(self) -> DataFrame:
        """level, status of the levels asked for; L3 and L4 share one pass over the records."""
        levels, out = list(self.spec.levels), None
        if self.spec.keys and {"L3", "L4"} <= set(levels):
            row = self.records.agg(F.count_if(F.col("status") != records.MATCHED).alias("L3"), F.coalesce(F.sum(fields.mismatches_of(self.records, self.pairs())), F.lit(0)).alias("L4"))
            both = [F.struct(F.lit(x).alias("level"), F.when(F.col(x) == 0, "PASS").otherwise("FAIL").alias("status")) for x in ("L3", "L4")]
            out = row.select(F.explode(F.array(*both)).alias("x")).select("x.*")
            levels = [x for x in levels if x not in ("L3", "L4")]
        for level in levels:
            row = self.metrics(level).select(F.lit(level).alias("level"), "status")
            out = row if out is None else out.unionByName(row)
        return out

    def rollup(self) -> DataFrame:
        return correlate.run_rollup(self.levels())


def reconcile(source: DataFrame, target: DataFrame, spec: ReconSpec) -> Reconciliation:
    return Reconciliation(source, target, spec)


def latest_results(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """The newest result of each run and task that succeeded, from result and task
    tables (run_id, task_id, created_at, ..; run_id, task_id, state)."""
    done = tasks.filter("state = 'SUCCESS'").select("run_id", "task_id").distinct()
    newest = results.join(done, ["run_id", "task_id"]).groupBy("run_id", "task_id").agg(F.max_by(F.struct(*results.columns), "created_at").alias("r"))
    return newest.select("r.*")


def run_listing(levels: DataFrame) -> DataFrame:
    """run_id, levels, failed_levels, status of written level statuses (run_id, level, status)."""
    failed = F.count_if(F.col("status").isin(*correlate.FAILING))
    rows = levels.groupBy("run_id").agg(F.count(F.lit(1)).alias("levels"), failed.alias("failed_levels"))
    return rows.withColumn("status", F.when(F.col("failed_levels") > 0, "FAIL").otherwise("PASS"))
