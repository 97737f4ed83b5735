"""Results of runs as tables: written so that a retry leaves each row once, and read by
page without sorting again.

Each run owns a folder of each table, which a write replaces whole. A state table says
whether a run is complete; it is written before the first table and after the last, so a
run that broke off is never listed as done. Rows go to files by ranges of the report's
order and are sorted within them; ``row`` numbers them in that order (with gaps from file
to file), so that a page is a range of ``row`` that Parquet's statistics find. A small
table of the files' sizes turns page numbers into such ranges.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..spec import require
from .privacy import guarded
from .reconcile import Reconciliation

RUNNING, DONE = "RUNNING", "DONE"
STATES = "run_id string, state string, created_at timestamp, spec string"
#: Most rows of a page.
PAGE = 200
#: ``row`` is the file's number times FILE and the row's number in it.
FILE = 1 << 33


class Results:
    """The result tables below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def folder(self, table: str, run_id: str) -> str:
        require(re.fullmatch(r"[\w.-]+", run_id), "a run is named by letters, digits, points and dashes")
        return f"{self.path}/{table}/run_id={run_id}"

    def put(self, df: DataFrame, table: str, run_id: str, order: list[str]) -> None:
        """Replaces the rows of a run, in the order of a report."""
        require("row" not in df.columns, "row is the name of the report's order")
        by = [col(c).asc_nulls_first() for c in order]
        sorted_rows = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df.coalesce(1)
        sorted_rows.withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(self.folder(table, run_id))
        rows = self.spark.read.parquet(self.folder(table, run_id))
        files = rows.groupBy(F.shiftright("row", 33).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        before = F.sum("rows").over(Window.orderBy("file")) - F.col("rows")  # a row a file
        files.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(self.folder(f"{table}_files", run_id))

    def state(self, run_id: str, state: str, created_at: datetime, spec: str) -> None:
        row = self.spark.createDataFrame([(run_id, state, created_at, spec)], STATES)
        row.drop("run_id").coalesce(1).write.mode("overwrite").parquet(self.folder("runs", run_id))

    def write(self, run: Reconciliation, run_id: str, created_at: datetime | None = None, private: tuple[str, ...] = (), key: bytes | None = None) -> None:
        """All levels of a run. Written again, for whatever reason, each row is there
        once. ``private`` columns leave as digests under ``key``."""
        created_at = created_at or datetime.now(timezone.utc)
        self.state(run_id, RUNNING, created_at, run.spec.to_json())
        for name, (df, order) in tables_of(run).items():
            self.put(guarded(df, run.spec, private, key), name, run_id, order)
        self.state(run_id, DONE, created_at, run.spec.to_json())

    def read(self, table: str, run_id: str) -> DataFrame:
        return self.spark.read.parquet(self.folder(table, run_id))

    def runs(self) -> DataFrame:
        """run_id, state, created_at, spec, levels, failed_levels, status (null unless
        done); newest first."""
        try:
            found = self.spark.read.parquet(f"{self.path}/runs").withColumn("run_id", F.col("run_id").cast("string"))
        except AnalysisException:  # no run yet
            return self.spark.createDataFrame([], f"{STATES}, levels long, failed_levels long, status string")
        try:
            levels = self.spark.read.parquet(f"{self.path}/levels").select(F.col("run_id").cast("string").alias("run_id"), F.col("status"))
        except AnalysisException:
            levels = self.spark.createDataFrame([], "run_id string, status string")
        counts = levels.groupBy("run_id").agg(F.count(F.lit(1)).alias("levels"), F.count_if(F.col("status").isin("FAIL", "ERROR")).alias("failed_levels"))
        out = found.join(counts, "run_id", "left")
        done = F.col("state") == DONE
        status = F.when(done, F.when(F.col("failed_levels") > 0, "FAIL").otherwise("PASS"))
        return out.select("run_id", "state", "created_at", "spec", F.when(done, F.col("levels")).alias("levels"), F.when(done, F.col("failed_levels")).alias("failed_levels"), status.alias("status")).orderBy(F.desc("created_at"), "run_id")

    def at(self, table: str, run_id: str, position: int) -> int | None:
        """``row`` of the row at a position (from 0), from the sizes of the files."""
        files = self.spark.read.parquet(self.folder(f"{table}_files", run_id))
        found = files.filter((F.col("before") <= position) & (F.col("before") + F.col("rows") > position)).first()
        return found and found["file"] * FILE + position - found["before"]

    def page(self, table: str, run_id: str, number: int, size: int = 100) -> DataFrame:
        """Page ``number`` (from 1): a range of ``row``, no sort of the table."""
        size = min(size, PAGE)
        first, last = (self.at(table, run_id, p) for p in ((number - 1) * size, number * size))
        rows = self.read(table, run_id)
        if first is None:
            return rows.limit(0)
        return self.between(rows, F.col("row") >= first, last).orderBy("row").limit(size)

    def after(self, table: str, run_id: str, row: int | None, size: int = 100) -> DataFrame:
        """The next page after the last ``row`` that was seen (null: the first page)."""
        size = min(size, PAGE)
        if row is None:
            return self.page(table, run_id, 1, size)
        files = self.spark.read.parquet(self.folder(f"{table}_files", run_id))
        own = files.filter(F.col("file") == row // FILE).first()
        last = own and self.at(table, run_id, own["before"] + row % FILE + 1 + size)
        return self.between(self.read(table, run_id), F.col("row") > row, last).orderBy("row").limit(size)

    @staticmethod
    def between(rows: DataFrame, begins: Column, last: int | None) -> DataFrame:
        return rows.filter(begins if last is None else begins & (F.col("row") < last))

    def from_key(self, table: str, run_id: str, key: dict, size: int = 100) -> DataFrame:
        """The page that begins with the first row whose columns are at or beyond ``key``
        in the report's order, nulls first. ``key`` names the first columns of that order
        in turn; the first one's bound reaches the scan."""
        beyond, alike = F.lit(False), F.lit(True)
        for name, value in key.items():
            c = col(name)
            beyond = beyond | (alike & (c.isNotNull() if value is None else c > F.lit(value)))
            alike = alike & c.eqNullSafe(F.lit(value))
        name, value = next(iter(key.items()))
        rows = self.read(table, run_id)
        rows = rows if value is None else rows.filter(col(name) >= F.lit(value))
        return rows.filter(beyond | alike).orderBy("row").limit(min(size, PAGE))


def tables_of(run: Reconciliation) -> dict[str, tuple[DataFrame, list[str]]]:
    """The results of a run by table, each with the order of its report."""
    ks = [f"k{i}" for i in range(len(run.spec.keys))]
    out = {"schema": (run.schema(), []), "volume": (run.volume(), [])}
    if run.spec.keys:
        out["records"] = run.records.drop("s", "t"), ["status", *ks, "source_ordinal", "target_ordinal"]
        out["mismatches"] = run.mismatches(), [*ks, "source_ordinal", "target_ordinal", "source_column"]
    if run.spec.aggregates:
        out["aggregates"] = run.aggregates(), ["rule", "group"]
    if run.spec.quality:
        out["quality"] = run.quality(), []
    return out | {"levels": (run.levels(), ["level"])}


def evidence(df: DataFrame, order: list[str], limit: int = 100) -> tuple[list[dict], int]:
    """At most ``limit`` rows for a report, in order, and how many there are: one pass
    gives both, since the rows are counted on their way to the sort. The order is that of
    a struct, nulls first: rows known to be sorted already would not all be looked at."""
    counted = Observation()
    rows = df.observe(counted, F.count(F.lit(1)).alias("n")).orderBy(F.struct(*map(col, order))).limit(limit).collect()
    return [r.asDict(True) for r in rows], counted.get.get("n", len(rows))
