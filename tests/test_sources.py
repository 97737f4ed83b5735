from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from congruity.operators.filters import apply_filters
from congruity.sources.footers import footer_row, footer_statistics
from congruity.sources.readers import analyze, catalogs, csv_schema, databases, default_registry, describe, empty, read_csv, read_jdbc, sizes, tables
from congruity.spec import RowFilter, SpecError


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_from_all_values(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,price,small,when,flag,name,blank\n1,10.5,0.123,2024-01-02,true,Café,\n2,12345,.5,2024-01-02 03:04:05,FALSE, x ,\n3,,1,2024-01-02T03:04:05Z,true,,\n")
    df = read_csv(spark, {"path": path})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert kinds == {"id": "bigint", "price": "decimal(6,1)", "small": "decimal(4,3)", "when": "timestamp", "flag": "boolean", "name": "string", "blank": "string"}
    row = df.orderBy("id").collect()[1]
    assert (str(row.price), str(row.small), row.flag, row.name) == ("12345.0", "0.500", False, " x ")


def test_csv_headers_delimiters_and_ragged_rows(spark, tmp_path):
    df = read_csv(spark, {"path": write(tmp_path / "b.csv", "a;b\n1;2\n3\n4;5;6\n\n"), "delimiter": ";"})
    assert sorted((r.a, r.b) for r in df.filter(F.col("b").isNotNull()).collect()) == [(1, 2), (4, 5)]
    with pytest.raises(SpecError):
        read_csv(spark, {"path": write(tmp_path / "c.csv", "a,A\n1,2\n")})


def test_late_values_decide_too(spark, tmp_path):
    path = write(tmp_path / "d.csv", "v\n" + "1\n" * 3000 + "x\n")
    assert csv_schema(spark.read.option("header", True).csv(path)).fields[0].dataType == T.StringType()


def test_yes_and_no_are_truth_values(spark, tmp_path):
    df = read_csv(spark, {"path": write(tmp_path / "y.csv", "a,b\nYes,1\nno,0\n,1\ntrue,0\n")})
    assert df.schema["a"].dataType == T.BooleanType() and df.schema["b"].dataType == T.LongType()
    assert [r.a for r in df.collect()] == [True, False, None, True]


def test_filters_read_dates_in_text(spark):
    df = spark.createDataFrame([("2024-01-02",), ("2024-03-01 10:00:00",), ("nope",), (None,)], "at string")
    assert apply_filters(df, (RowFilter("at", ">", date(2024, 2, 1)),)).count() == 1
    assert apply_filters(df, (RowFilter("at", ">=", datetime(2024, 3, 1, 10)),)).count() == 1
    assert apply_filters(df, (RowFilter("at", "IN", [date(2024, 1, 2)]),)).count() == 1


def test_analysis(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)], "n int, t string, d date")
    assert analyze(df).first().asDict() == {"rows": 2, "columns": 3, "numeric": 1, "text": 1, "temporal": 1, "with_nulls": 2}
    assert "spark_catalog" in catalogs(spark)


def test_jdbc_options_name_what_is_read(spark):
    with pytest.raises(Exception, match="(?i)driver|jdbc"):
        read_jdbc(spark, {"url": "jdbc:none://host/db", "table": "t"})
    ok, why = default_registry().test(spark, "postgres", {"url": "jdbc:postgresql://host/db", "query": "SELECT 1", "user": "u", "password": "p", "column": "id", "lower": 0, "upper": 9, "partitions": 2})
    assert not ok and why


def test_registry_and_discovery(spark, tmp_path):
    r = default_registry()
    spark.range(3).write.parquet(f"{tmp_path}/p")
    spark.range(3).write.orc(f"{tmp_path}/o")
    spark.range(3).write.json(f"{tmp_path}/j")
    for name in ("parquet", "ORC", "json"):
        assert r.read(spark, name, {"path": f"{tmp_path}/{name[0].lower()}"}).count() == 3
    assert r.test(spark, "parquet", {"path": f"{tmp_path}/p"}) == (True, "id")
    assert not r.test(spark, "parquet", {"path": f"{tmp_path}/none"})[0]
    with pytest.raises(SpecError):
        r.register("CSV", read_csv)
    with pytest.raises(SpecError):
        r.read(spark, "mongo", {})
    spark.range(2).createOrReplaceTempView("two")
    assert r.read(spark, "table", {"name": "two"}).count() == 2
    assert "two" in tables(spark) and "default" in databases(spark)
    assert empty(spark, spark.range(1).schema).count() == 0
    size = sizes(spark, f"{tmp_path}/p").first()
    assert size.files >= 1 and size.bytes > 0
    assert describe(spark.range(1)).first().type == "bigint"


def test_footers_give_statistics_without_a_scan(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 4 != 0, F.col("id") * -2).cast("int").alias("a.b"), F.lit("x").alias("t"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("d"), F.array("id").alias("l"), (F.col("id") / 4).alias("f"))
    rows.repartition(3).write.parquet(str(tmp_path / "p"))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    got = {r["column"]: r for r in footer_statistics(spark, str(tmp_path / "p")).collect()}
    assert {c: (r.rows, r.nulls, r.low, r.high) for c, r in got.items()} == {
        "id": (1000, 0, "0", "999"), "a.b": (1000, 250, "-1998", "-2"), "t": (1000, 0, None, None), "d": (1000, 0, "19723", "19731"), "l": (1000, None, None, None), "f": (1000, 0, "0.0", "249.75"),
    }
    plan = footer_row(spark, str(tmp_path / "p"))._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedAggregation: ")[1].split("]")[0]
    assert "COUNT(*)" in pushed and "MAX(id)" in pushed and "COUNT(`a.b`)" in pushed
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    spark.range(0).write.parquet(str(tmp_path / "e"))
    assert footer_statistics(spark, str(tmp_path / "e")).first().rows == 0
