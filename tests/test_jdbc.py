"""Parallel reads of a database that runs in this process."""

import os
import subprocess
import sys
import uuid
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from congruity.operators.filters import apply_filters
from congruity.sources.jdbc import borders, discover, jdbc_tables, literal, read_jdbc, relation, strides, write_jdbc
from congruity.sources.readers import default_registry
from congruity.spec import RowFilter, SpecError


@pytest.fixture
def db(spark):
    return {"url": f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def skewed(spark):
    """Half of all rows in a thousandth of the range, one key very often, some nulls."""
    near, far = spark.range(3000).select((F.col("id") % 900).alias("id")), spark.range(2000).select((F.col("id") * 5000).alias("id"))
    often, none = spark.range(1000).select(F.lit(7).cast("long").alias("id")), spark.range(40).select(F.lit(None).cast("long").alias("id"))
    rows = near.unionByName(far).unionByName(often).unionByName(none)
    return rows.select("id", F.coalesce(F.col("id") % 3, F.lit(9)).alias("kind"), F.lit("é' x").alias("note"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("day"))


def test_strides_follow_the_rows(spark, db):
    rows = skewed(spark)
    write_jdbc(rows, db | {"table": "t"})
    p = db | {"table": "T", "column": "ID", "partitions": 8}
    df = read_jdbc(spark, p)
    assert sorted(map(str, df.collect())) == sorted(map(str, rows.collect()))
    sizes = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert df.rdd.getNumPartitions() >= 6 and max(sizes) < 2000  # the frequent key has 1004 rows, a fair share 755
    even = spark.read.format("jdbc").options(**db, dbtable="t", partitionColumn="id", lowerBound=0, upperBound=9_995_000, numPartitions=8).load()
    assert max(r.n for r in even.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) > 4000


def test_filters_and_columns_reach_the_database(spark, db):
    write_jdbc(skewed(spark), db | {"table": "t", "text": "VARCHAR(20)"})
    df = read_jdbc(spark, db | {"table": "t", "column": "id", "partitions": 4})
    kept = apply_filters(df, (RowFilter("id", ">=", 100), RowFilter("kind", "IN", [0, 1]), RowFilter("note", "=", "é' x"))).select("id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(id,100)" in pushed and "In(kind" in pushed and "EqualTo(note,é' x)" in pushed
    assert "struct<id:bigint>" in plan.split("ReadSchema: ")[1].split("\n")[0]
    assert kept.count() == skewed(spark).filter("id >= 100 AND kind IN (0, 1)").count()


def test_queries_dates_and_cuts(spark, db):
    write_jdbc(skewed(spark), db | {"table": "t"})
    q = read_jdbc(spark, db | {"query": 'SELECT "id", "day" FROM t WHERE "kind" = 1', "column": "id", "partitions": 3})
    assert q.count() == skewed(spark).filter("kind = 1").count() and q.rdd.getNumPartitions() >= 3
    cut = read_jdbc(spark, db | {"table": "t", "column": "day", "cuts": [date(2024, 1, 20), date(2024, 1, 5), date(2024, 1, 5)]})
    assert cut.rdd.getNumPartitions() == 3 and cut.count() == 6040
    with pytest.raises(SpecError, match="whole numbers"):
        read_jdbc(spark, db | {"table": "t", "column": "day", "partitions": 2})


def test_empty_tables_and_single_values(spark, db):
    write_jdbc(skewed(spark).limit(0), db | {"table": "nil"})
    write_jdbc(skewed(spark).filter("id = 7"), db | {"table": "one"})
    assert read_jdbc(spark, db | {"table": "nil", "column": "id", "partitions": 4}).collect() == []
    one = read_jdbc(spark, db | {"table": "one", "column": "id", "partitions": 4})
    assert one.count() == 1004 and borders(spark, db | {"table": "one"}, '"id"', 4) == []
    write_jdbc(spark.range(-500, 500), db | {"table": "signed"})
    assert read_jdbc(spark, db | {"table": "signed", "column": "id", "partitions": 5}).count() == 1000


def test_writes_discovery_and_connection_tests(spark, db):
    write_jdbc(spark.range(3), db | {"table": "a"})
    write_jdbc(spark.range(2), db | {"table": "a"}, "append")
    assert read_jdbc(spark, db | {"table": "a"}).count() == 5
    write_jdbc(spark.range(1), db | {"table": "a"}, "overwrite")
    found = discover(spark, db)
    assert [(r.table_name, r.table_type) for r in found.filter("table_schema = 'APP'").collect()] == [("A", "BASE TABLE")] and found.count() == 1
    assert jdbc_tables(spark, db, "SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'") == ["A"]
    known = default_registry()
    assert known.test(spark, "jdbc", db | {"table": "a"}) == (True, "id")
    for bad in ({"table": "nothing"}, {"table": "a", "driver": "no.such.Driver"}, {"query": "SELECT nothing"}, {"table": "a; DROP"}, {}):
        ok, why = known.test(spark, "jdbc", db | bad)
        assert not ok and why, bad


def test_sql_that_is_written():
    assert strides('"x"', []) == ["1 = 1"] and strides("x", [5]) == ["x < 5 OR x IS NULL", "x >= 5"]
    assert strides("x", [5, 9])[1] == "x >= 5 AND x < 9"
    assert literal(date(2024, 1, 2)) == "DATE('2024-01-02')" and literal(datetime(2024, 1, 2, 3)) == "TIMESTAMP('2024-01-02 03:00:00')"
    assert relation({"query": "SELECT 1"}) == "(SELECT 1) q" and relation({"table": "a.b"}) == "a.b"
    for bad in ({}, {"table": "a", "query": "b"}, {"table": "a b"}):
        with pytest.raises(SpecError):
            relation(bad)


def test_a_database_is_read_by_executors_of_their_own(tmp_path):
    here = Path(__file__).resolve().parent.parent
    code = f"""
from pyspark.sql import SparkSession
from congruity.plans.catalog import QUERIES
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
print("rows", [tuple(r) for r in QUERIES["source_discovery"](spark, "/root/testdata/sf0.001").orderBy("name").collect()])
"""
    settings = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"PYTHONPATH": str(here)}
    done = subprocess.run([sys.executable, "-c", code], env=settings, capture_output=True, text=True, timeout=240)
    assert "rows [('NATION', 'BASE TABLE', 25), ('REGION', 'BASE TABLE', 5)]" in done.stdout, done.stderr[-2000:]
