"""Readers by name, CSV types, catalog discovery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..spec import require
from .jdbc import read_jdbc

Reader = Callable[[SparkSession, dict], DataFrame]
#: Texts of numbers, moments and truth values in CSV files.
WHOLE = r"^[+-]?\d{1,18}$"
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)$"
MOMENT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
TRUE, FALSE = ("true", "yes"), ("false", "no")


def csv_schema(rows: DataFrame) -> T.StructType:
    """Types of all-text columns from every value, in one aggregate.

    A column is BOOLEAN, LONG, DECIMAL, TIMESTAMP or STRING, the first that all its
    values without blanks fit; a blank column is STRING. DECIMAL has room for the
    most digits on either side of the point. Nullable where a value is blank.
    """
    aggs = []
    for i, c in enumerate(rows.columns):
        v = F.trim(col(c))
        v = F.when(v != "", v)
        point = F.when(v.rlike(DECIMAL), v)
        aggs += [
            F.count(v).alias(f"n{i}"), F.count_if(F.lower(v).isin(*TRUE, *FALSE)).alias(f"b{i}"), F.count_if(v.rlike(WHOLE)).alias(f"w{i}"), F.count(point).alias(f"d{i}"),
            F.count_if(v.rlike(MOMENT) & v.try_cast("timestamp").isNotNull()).alias(f"t{i}"), F.count_if(v.isNull()).alias(f"e{i}"),
            F.max(F.length(F.regexp_replace(F.regexp_extract(point, r"^[+-]?(\d*)", 1), "^0+", ""))).alias(f"p{i}"), F.max(F.length(F.regexp_extract(point, r"\.(\d+)$", 1))).alias(f"s{i}"),
        ]
    r = rows.agg(*aggs).first().asDict()
    fields = []
    for i, c in enumerate(rows.columns):
        n = r[f"n{i}"]
        scale = min(r[f"s{i}"] or 0, 38)
        digits = max(r[f"p{i}"] or 0, 1)
        found = T.StringType()
        if n and r[f"b{i}"] == n:
            found = T.BooleanType()
        elif n and r[f"w{i}"] == n:
            found = T.LongType()
        elif n and r[f"d{i}"] == n and digits + scale <= 38:
            found = T.DecimalType(digits + scale, scale)
        elif n and r[f"t{i}"] == n:
            found = T.TimestampType()
        fields.append(T.StructField(c, found, bool(r[f"e{i}"]) or not n))
    return T.StructType(fields)


def read_csv(spark: SparkSession, p: dict) -> DataFrame:
    """path, delimiter, encoding, schema (else from all values), strict (fail on bad rows)."""
    options = {"header": "true", "sep": p.get("delimiter", ","), "encoding": p.get("encoding", "UTF-8"), "mode": "FAILFAST" if p.get("strict") else "PERMISSIVE"}
    text = spark.read.options(**options).csv(p["path"])
    header = spark.read.options(**options | {"header": "false"}).csv(p["path"]).limit(1).first()
    require(header, "the file has no header")
    names = [str(c).strip().lower() for c in header]  # the reader renames what repeats
    require(len(set(names)) == len(names), "the header repeats a name")
    schema = p.get("schema") or csv_schema(text)
    kinds = {f.name: f.dataType for f in schema.fields}
    picked = []
    for c in text.columns:
        v = F.trim(col(c))
        if isinstance(kinds[c], T.BooleanType):
            v = F.lower(v)
            v = F.when(v.isin(*TRUE), "true").when(v.isin(*FALSE), "false").otherwise("")
        picked.append((col(c) if isinstance(kinds[c], T.StringType) else F.when(v != "", v).try_cast(kinds[c])).alias(c))
    return text.select(*picked)


def columnar(name: str) -> Reader:
    def read(spark: SparkSession, p: dict) -> DataFrame:
        reader = spark.read.format(name)
        return (reader.schema(p["schema"]) if "schema" in p else reader).load(p["path"])

    return read


class Registry:
    """Readers by name, without regard to case."""

    def __init__(self) -> None:
        self.readers: dict[str, Reader] = {}

    def register(self, name: str, reader: Reader) -> None:
        require(name.lower() not in self.readers, f"reader {name} is registered already")
        self.readers[name.lower()] = reader

    def read(self, spark: SparkSession, name: str, properties: dict) -> DataFrame:
        require(name.lower() in self.readers, f"no reader {name}")
        return self.readers[name.lower()](spark, properties)

    def test(self, spark: SparkSession, name: str, properties: dict) -> tuple[bool, str]:
        """Whether a dataset opens and its first row can be read; its columns, or what
        went wrong."""
        try:
            found = self.read(spark, name, properties)
            found.limit(1).collect()
            return True, ", ".join(found.columns)
        except Exception as e:  # whatever the source raises is the answer
            return False, str(e).splitlines()[0]


def default_registry() -> Registry:
    out = Registry()
    out.register("csv", read_csv)
    out.register("jdbc", read_jdbc)
    out.register("postgres", lambda spark, p: read_jdbc(spark, {"driver": "org.postgresql.Driver"} | p))
    out.register("table", lambda spark, p: spark.table(p["name"]))
    for name in ("parquet", "orc", "json"):
        out.register(name, columnar(name))
    return out


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def catalogs(spark: SparkSession) -> list[str]:
    return [c.name for c in spark.catalog.listCatalogs()]


def databases(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return [t.name for t in spark.catalog.listTables(database)]


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """files, bytes below ``path``, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def analyze(df: DataFrame) -> DataFrame:
    """One row: rows, columns, and of all columns how many are numbers, text, moments, or
    have nulls, from one aggregate."""
    count = {"numeric": T.NumericType, "text": T.StringType, "temporal": (T.DateType, T.TimestampType, T.TimestampNTZType)}
    row = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)))
    with_nulls = sum((F.when(F.col(f"n{i}") > 0, 1).otherwise(0) for i in range(len(df.columns))), F.lit(0))
    kinds = [F.lit(sum(isinstance(f.dataType, t) for f in df.schema.fields)).alias(name) for name, t in count.items()]
    return row.select("rows", F.lit(len(df.columns)).alias("columns"), *kinds, with_nulls.alias("with_nulls"))


def describe(df: DataFrame) -> DataFrame:
    """ordinal, column, type, nullable."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, type string, nullable boolean")
