"""Tables of databases, read in parallel.

The strides of a read come from the database itself: it groups its rows into narrow
ranges of a column and counts them, and ranges are put together until each partition has
about as many rows. A range that holds more than its share is counted again by itself, so
that skew does not end in one task. Filters and columns are pushed to the database by
Spark; the strides are predicates beside them.
"""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..spec import require

#: Ranges that a database counts at once, and how often a heavy one is divided again.
RANGES, DEPTH = 256, 4
NAME = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*")
EXTRA = ("user", "password", "driver", "fetchsize", "sessionInitStatement", "queryTimeout")


def options(p: dict) -> dict[str, str]:
    return {"url": p["url"]} | {n: str(p[n]) for n in EXTRA if n in p}


def relation(p: dict) -> str:
    """The table, or the query as one."""
    require(("table" in p) != ("query" in p), "name a table or a query")
    if "query" in p:
        return f"({p['query']}) q"
    require(NAME.fullmatch(p["table"]), f"{p['table']} is no name of a table")
    return p["table"]


def ask(spark: SparkSession, p: dict, sql: str) -> list:
    """The rows of a small query, run by the database as it stands."""
    return spark.read.format("jdbc").options(**options(p), dbtable=f"({sql}) a").load().collect()


def literal(x: object) -> str:
    if isinstance(x, datetime):
        return f"TIMESTAMP('{x:%Y-%m-%d %H:%M:%S.%f}')" if x.microsecond else f"TIMESTAMP('{x:%Y-%m-%d %H:%M:%S}')"
    return f"DATE('{x:%Y-%m-%d}')" if isinstance(x, date) else str(x)


def borders(spark: SparkSession, p: dict, column: str, partitions: int) -> list[int]:
    """Values of a column of whole numbers that divide the rows into about equal parts,
    by counts that the database makes: one row a range comes back, never a table."""
    name = relation(p)

    def counts(low: int, high: int) -> list[tuple[int, int, int]]:
        """least, greatest, rows of each of at most RANGES ranges."""
        width = max(1, -(-(high - low + 1) // RANGES))
        inner = f"SELECT {column} AS v, ({column} - ({low})) / {width} AS r FROM {name} WHERE {column} >= {low} AND {column} <= {high}"
        rows = ask(spark, p, f"SELECT r, MIN(v) AS a, MAX(v) AS b, COUNT(*) AS n FROM ({inner}) i GROUP BY r")
        return sorted((int(r[1]), int(r[2]), int(r[3])) for r in rows)

    ends = ask(spark, p, f"SELECT MIN({column}) AS a, MAX({column}) AS b, COUNT({column}) AS n FROM {name}")[0]
    if not ends[2]:
        return []
    share, parts = max(1, -(-int(ends[2]) // partitions)), counts(int(ends[0]), int(ends[1]))
    for _ in range(DEPTH):
        heavy = [x for x in parts if x[2] > share / 4 and x[0] < x[1]]
        if not heavy:
            break
        for x in heavy[: 4 * partitions]:
            parts.remove(x)
            parts += counts(x[0], x[1])
        parts.sort()
    out, held = [], 0
    for low, _, n in parts:
        if held and held + n > share:
            out.append(low)
            held = 0
        held += n
    return out


def strides(column: str, cuts: list) -> list[str]:
    """A predicate for each partition; together they hold every row once."""
    if not cuts:
        return ["1 = 1"]
    middle = [f"{column} >= {literal(a)} AND {column} < {literal(b)}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{column} < {literal(cuts[0])} OR {column} IS NULL", *middle, f"{column} >= {literal(cuts[-1])}"]


def read_jdbc(spark: SparkSession, p: dict) -> DataFrame:
    """url, table or query, user, password, driver, fetchsize, and for a read in parallel
    column and partitions: strides from counts in the database, for whole numbers; or
    cuts, the values between the strides, of numbers, dates or moments. quote is what the
    database puts around names."""
    name = relation(p)
    reader = spark.read.format("jdbc").options(**options(p))
    if "column" not in p:
        return reader.option("dbtable", name).load()
    found = {f.name.lower(): f for f in reader.option("dbtable", name).load().schema.fields}
    require(p["column"].lower() in found, f"no column {p['column']}")
    field = found[p["column"].lower()]
    quote = p.get("quote", '"')
    column = quote + field.name.replace(quote, quote * 2) + quote  # as the database spells it
    if "cuts" in p:
        cuts = sorted(set(p["cuts"]))
    else:
        whole = isinstance(field.dataType, T.IntegralType) or isinstance(field.dataType, T.DecimalType) and field.dataType.scale == 0
        require(whole, f"{field.name} is no column of whole numbers: give the cuts")
        require(p.get("partitions", 0) >= 1, "say how many partitions")
        cuts = borders(spark, p, column, int(p["partitions"]))
    known = {k: v for k, v in options(p).items() if k != "url"}
    return spark.read.jdbc(p["url"], name, predicates=strides(column, cuts), properties=known)


def write_jdbc(df: DataFrame, p: dict, mode: str = "errorifexists") -> None:
    """Appends to or replaces a table; ``batchsize`` rows go at once. ``text`` is the type
    of columns of text in a new table, where the database's default can't be compared."""
    require("table" in p and NAME.fullmatch(p["table"]), "name a table")
    writer = df.write.format("jdbc").options(**options(p), dbtable=p["table"], batchsize=str(p.get("batchsize", 1000)))
    text = [f"`{f.name}` {p['text']}" for f in df.schema.fields if isinstance(f.dataType, T.StringType)] if "text" in p else []
    (writer.option("createTableColumnTypes", ", ".join(text)) if text else writer).mode(mode).save()


def jdbc_tables(spark: SparkSession, p: dict, sql: str) -> list[str]:
    """Names of tables, by the database's own query: one text column."""
    return sorted(str(r[0]).strip() for r in ask(spark, p, sql))


def discover(spark: SparkSession, p: dict) -> DataFrame:
    """catalog, schema, name, type: tables and views of the database that the user may
    see, from the standard views where it has them, else from its own ones."""
    schema = "table_catalog string, table_schema string, table_name string, table_type string"
    if p["url"].startswith("jdbc:derby"):
        sql = "SELECT 'derby' AS c, s.SCHEMANAME AS s, t.TABLENAME AS n, CASE t.TABLETYPE WHEN 'V' THEN 'VIEW' ELSE 'BASE TABLE' END AS k FROM SYS.SYSTABLES t JOIN SYS.SYSSCHEMAS s ON s.SCHEMAID = t.SCHEMAID WHERE t.TABLETYPE IN ('T', 'V')"
    else:
        sql = "SELECT table_catalog AS c, table_schema AS s, table_name AS n, table_type AS k FROM information_schema.tables WHERE table_schema NOT IN ('information_schema', 'pg_catalog')"
    return spark.read.format("jdbc").options(**options(p), dbtable=f"({sql}) a").load().toDF(*(c.split()[0] for c in schema.split(", ")))
