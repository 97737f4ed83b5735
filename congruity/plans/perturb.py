"""Pairs of datasets to compare: tables and deterministic variants of them.

The variants are SQL that Spark and other engines read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ORDER_COLUMNS = "o_custkey, o_orderstatus, CAST({price} AS DECIMAL(18,2)) AS o_totalprice, o_orderdate, {priority} AS o_orderpriority"
PLAIN = ORDER_COLUMNS.format(price="o_totalprice", priority="o_orderpriority")

ORDERS_S = f"SELECT CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey, {PLAIN} FROM orders"
ORDERS_T = f"""
SELECT CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey,
       {ORDER_COLUMNS.format(price="CASE WHEN o_orderkey % 37 = 0 THEN o_totalprice + 1.5 ELSE o_totalprice END", priority="CASE WHEN o_orderkey % 41 = 0 THEN concat('  ', lower(o_orderpriority), ' ') ELSE o_orderpriority END")}
FROM orders WHERE o_orderkey % 50 <> 0
UNION ALL SELECT o_orderkey + 10000000, {PLAIN} FROM orders WHERE o_orderkey % 71 = 0
UNION ALL SELECT o_orderkey, {PLAIN} FROM orders WHERE o_orderkey % 83 = 0
"""

CUSTOMER_S = "SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, CASE WHEN c_custkey % 29 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer"
CUSTOMER_T = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN concat(' ', upper(c_name)) ELSE c_name END AS full_name,
       CAST(c_nationkey AS BIGINT) AS nation, CAST(CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 0.004 WHEN c_custkey % 13 = 0 THEN c_acctbal * 1.04 ELSE c_acctbal END AS DECIMAL(18,3)) AS balance,
       CASE WHEN c_custkey % 29 = 0 OR c_custkey % 31 = 0 THEN NULL ELSE c_mktsegment END AS segment, 1 AS version
FROM customer WHERE c_custkey % 50 <> 3
"""

LINE_COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST({quantity} AS DECIMAL(18,2)) AS l_quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice, {flag} AS l_returnflag, l_shipdate"
LINEITEM_S = f"SELECT {LINE_COLUMNS.format(quantity='l_quantity', flag='l_returnflag')} FROM lineitem"
LINEITEM_T = f"""
SELECT {LINE_COLUMNS.format(quantity="CASE WHEN l_partkey % 23 = 0 THEN l_quantity + 1 ELSE l_quantity END", flag="CASE WHEN l_suppkey % 19 = 0 THEN lower(l_returnflag) ELSE l_returnflag END")}
FROM lineitem WHERE l_partkey % 47 <> 0
UNION ALL SELECT {LINE_COLUMNS.format(quantity="l_quantity", flag="l_returnflag")} FROM lineitem WHERE l_partkey % 53 = 0
"""


def build(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the queries above over the tables of ``sf_dir``."""
    names = set(re.findall(r"FROM (\w+)", sql))
    bound = re.sub(r"FROM (\w+)", r"FROM {\1}", sql)
    return spark.sql(bound, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})
