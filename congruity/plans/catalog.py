"""Every reconciliation query of the harness, by name, with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import suppress
from dataclasses import replace
from datetime import date, datetime, timedelta, timezone
from functools import reduce
from pathlib import Path
from zipfile import ZipFile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates, checksum, correlate, fields, filters, groups, profile, quality, records, sampling, schema_diff, sketches
from ..sources import footers, jdbc, readers
from ..sources.shared import shared_dir
from ..spec import AggregateRule, GroupSpec, Mapping, QualityRule, ReconSpec, RowFilter, require
from ..streaming import events
from ..streaming import runs as runs_of
from . import perturb
from .perturb import build
from .reconcile import Reconciliation, latest_results, run_listing
from .results import Results, evidence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under the name of its function, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


# Specifications

LOOSE = {"trim": True, "case_insensitive": True}
ORDERS = ReconSpec(keys=(("o_orderkey", "o_orderkey"),))
ORDERS_LOOSE = ReconSpec(keys=ORDERS.keys, mappings=(Mapping("o_orderpriority", "o_orderpriority", LOOSE),))
CUSTOMERS = ReconSpec(
    keys=(("c_custkey", "id"),),
    mappings=(Mapping("c_name", "full_name"), Mapping("c_nationkey", "nation"), Mapping("c_acctbal", "balance"), Mapping("c_mktsegment", "segment")),
    ignore_target=frozenset(("version",)),
)
LINES = ReconSpec(keys=(("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")))
BY_CUSTOMER = GroupSpec((Mapping("o_custkey", "o_custkey"),), ((Mapping("o_totalprice", "o_totalprice"), "SUM"), (Mapping("o_orderpriority", "o_orderpriority", LOOSE), "MODE")))
ORDERS_GROUPED = ReconSpec(keys=ORDERS.keys, mappings=ORDERS_LOOSE.mappings, groups=BY_CUSTOMER)


def orders(spark: SparkSession, d: str, spec: ReconSpec = ORDERS) -> Reconciliation:
    return Reconciliation(build(spark, d, perturb.ORDERS_S), build(spark, d, perturb.ORDERS_T), spec)


def customers(spark: SparkSession, d: str, spec: ReconSpec = CUSTOMERS) -> Reconciliation:
    return Reconciliation(build(spark, d, perturb.CUSTOMER_S), build(spark, d, perturb.CUSTOMER_T), spec)


def lines(spark: SparkSession, d: str, spec: ReconSpec = LINES) -> Reconciliation:
    return Reconciliation(build(spark, d, perturb.LINEITEM_S), build(spark, d, perturb.LINEITEM_T), spec)


def customers_as(name: str, target: str, how: dict | None = None, **tolerance) -> ReconSpec:
    """CUSTOMERS with one mapping compared in another way."""
    mappings = tuple(Mapping(name, target, how or {}, **tolerance) if m.source == name else m for m in CUSTOMERS.mappings)
    return ReconSpec(keys=CUSTOMERS.keys, mappings=mappings, ignore_target=CUSTOMERS.ignore_target)


# SQL of the pairs

def pairs_sql(s: str, t: str, keys: list[tuple[str, str]], columns: list[tuple[str, str]], order: dict[str, str] | None = None) -> str:
    """CTEs s, t and pairs: k0.., status, s_.., t_.., counts and ordinals. ``order``:
    another expression for a column where it orders the rows of a key."""
    order = order or {}
    ks = [f"k{i}" for i in range(len(keys))]
    k_list, on = ", ".join(ks), " AND ".join(f"a.{k} = b.{k}" for k in ks)

    def side(name: str, n: int) -> str:
        named = ", ".join([*(f"{k[n]} AS k{i}" for i, k in enumerate(keys)), *(f"{c[n]} AS v_{c[0]}" for c in columns)])
        by = ", ".join(f"{order.get(c[0], 'v_' + c[0]).replace('@', 'v_' + c[0])} NULLS FIRST" for c in columns)
        return f"""{name}0 AS (SELECT {named} FROM {name}),
        {name}1 AS (SELECT *, row_number() OVER (PARTITION BY {k_list} ORDER BY {by}) AS ord, count(*) OVER (PARTITION BY {k_list}) AS kc FROM {name}0 WHERE {' AND '.join(f'{k} IS NOT NULL' for k in ks)})"""

    def values(of_s: str, of_t: str) -> str:
        one = [f"{of_s}.v_{c[0]} AS s_{c[0]}" if of_s else f"NULL AS s_{c[0]}" for c in columns] + [f"{of_t}.v_{c[0]} AS t_{c[0]}" if of_t else f"NULL AS t_{c[0]}" for c in columns]
        return ", ".join(one)

    bad = " OR ".join(f"a.{k} IS NULL" for k in ks)
    a_list = ", ".join(f"a.{k}" for k in ks)
    return f"""WITH s AS ({s}), t AS ({t}), {side('s', 0)}, {side('t', 1)},
        pairs AS (
            SELECT {a_list}, 'MATCHED' AS status, {values('a', 'b')}, a.kc AS source_key_count, b.kc AS target_key_count, a.ord AS source_ordinal, b.ord AS target_ordinal
            FROM s1 a JOIN t1 b ON {on} AND (a.ord = b.ord OR b.ord = 1 AND a.ord > b.kc OR a.ord = 1 AND b.ord > a.kc)
            UNION ALL BY NAME SELECT {a_list}, 'MISSING_IN_TARGET' AS status, {values('a', '')}, a.kc AS source_key_count, 0 AS target_key_count, a.ord AS source_ordinal FROM s1 a ANTI JOIN t1 b ON {on}
            UNION ALL BY NAME SELECT {a_list}, 'EXTRA_IN_TARGET' AS status, {values('', 'a')}, 0 AS source_key_count, a.kc AS target_key_count, a.ord AS target_ordinal FROM t1 a ANTI JOIN s1 b ON {on}
            UNION ALL BY NAME SELECT {a_list}, 'UNMATCHABLE_SOURCE' AS status, {values('a', '')} FROM s0 a WHERE {bad}
            UNION ALL BY NAME SELECT {a_list}, 'UNMATCHABLE_TARGET' AS status, {values('', 'a')} FROM t0 a WHERE {bad}
        )"""


ORDER_NAMES = [(c, c) for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]
PAIRS_O = pairs_sql(perturb.ORDERS_S, perturb.ORDERS_T, [("o_orderkey", "o_orderkey")], ORDER_NAMES)
PAIRS_OL = pairs_sql(perturb.ORDERS_S, perturb.ORDERS_T, [("o_orderkey", "o_orderkey")], ORDER_NAMES, {"o_orderpriority": "lower(trim(@))"})
PAIRS_ST = pairs_sql(perturb.ORDERS_S, perturb.ORDERS_T, [("o_orderstatus", "o_orderstatus")], [(c, c) for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")])
PAIRS_CC = pairs_sql(perturb.CUSTOMER_S, perturb.CUSTOMER_S, [("c_custkey", "c_custkey")], [(c, c) for c in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")])
PAIRS_C = pairs_sql(perturb.CUSTOMER_S, perturb.CUSTOMER_T, [("c_custkey", "id")], [("c_name", "full_name"), ("c_nationkey", "nation"), ("c_acctbal", "balance"), ("c_mktsegment", "segment")])
PAIRS_L = pairs_sql(perturb.LINEITEM_S, perturb.LINEITEM_T, [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")], [(c, c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")])
S_AND_T = f"WITH s AS ({perturb.ORDERS_S}), t AS ({perturb.ORDERS_T})"
C_AND_T = f"WITH s AS ({perturb.CUSTOMER_S}), t AS ({perturb.CUSTOMER_T})"


# Filters

@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderkey <> 7")
def filter_eq(spark, d):
    return filters.apply_filters(spark.read.parquet(f"{d}/orders.parquet"), (RowFilter("o_orderstatus", "=", "F"), RowFilter("o_orderkey", "!=", 7))).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 50000 AND o_orderkey >= 10 AND o_orderkey < 9000")
def filter_range(spark, d):
    some = (RowFilter("o_totalprice", ">", 1000), RowFilter("o_totalprice", "<=", 50000), RowFilter("o_orderkey", ">=", 10), RowFilter("o_orderkey", "<", 9000))
    return filters.apply_filters(spark.read.parquet(f"{d}/orders.parquet"), some).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in(spark, d):
    return filters.apply_filters(spark.read.parquet(f"{d}/customer.parquet"), (RowFilter("c_mktsegment", "in", ["BUILDING", "MACHINERY"]),)).select("c_custkey")


@query(f"WITH t AS ({perturb.CUSTOMER_T}) SELECT 'null' AS side, count(*) AS n FROM t WHERE segment IS NULL UNION ALL SELECT 'not null', count(*) FROM t WHERE segment IS NOT NULL UNION ALL SELECT 'unequal', count(*) FROM t WHERE segment IS DISTINCT FROM 'BUILDING'")
def filter_null(spark, d):
    t = build(spark, d, perturb.CUSTOMER_T)
    parts = [("null", RowFilter("segment", "IS NULL"), False), ("not null", RowFilter("segment", "is_not_null"), False), ("unequal", RowFilter("segment", "!=", "BUILDING"), True)]
    counts = [filters.apply_filters(t, (f,), loose).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n") for name, f, loose in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# Level 1

@query("""SELECT * FROM (VALUES ('c_nationkey', 'nation', 'DATA_TYPE_CHANGED', 'int', 'bigint'), ('c_acctbal', 'balance', 'DATA_TYPE_CHANGED', 'decimal(18,2)', 'decimal(18,3)'),
    ('c_mktsegment', 'mktsegment', 'MISSING_COLUMN', 'string', NULL), (NULL, 'segment', 'UNEXPECTED_COLUMN', NULL, 'string')) AS x("column", target_column, drift, source_type, target_type)""")
def l1_schema_diff(spark, d):
    wrong = ReconSpec(keys=CUSTOMERS.keys, mappings=(*CUSTOMERS.mappings[:3], Mapping("c_mktsegment", "mktsegment")), ignore_target=CUSTOMERS.ignore_target)
    return schema_diff.schema_diff(build(spark, d, perturb.CUSTOMER_S), build(spark, d, perturb.CUSTOMER_T), wrong)


# Level 2

@query(f"{S_AND_T} SELECT count(*) AS total_rows, count(o_orderkey) AS keyed_rows, count(DISTINCT o_orderkey) AS distinct_keys, count(o_orderkey) - count(DISTINCT o_orderkey) AS duplicate_rows, count(*) - count(o_orderkey) AS unusable_rows FROM t")
def l2_profile(spark, d):
    return profile.key_counts(build(spark, d, perturb.ORDERS_T), ["o_orderkey"])


@query(f"""{C_AND_T}, n AS (SELECT (SELECT count(*) FROM s WHERE c_mktsegment IS NULL) AS a, (SELECT count(*) FROM t WHERE segment IS NULL) AS b)
    SELECT c AS "column", m AS target_column, x AS source_nulls, y AS target_nulls, x = y AS matched FROM (SELECT 'c_mktsegment' AS c, 'segment' AS m, a AS x, b AS y FROM n
    UNION ALL SELECT c, m, 0, 0 FROM (VALUES ('c_custkey', 'id'), ('c_name', 'full_name'), ('c_nationkey', 'nation'), ('c_acctbal', 'balance')) AS v(c, m))""")
def l2_null_counts_mapped(spark, d):
    r = customers(spark, d)
    return profile.mapped_null_counts(r.source, r.target, r.spec)


@query(f"""{S_AND_T}, a AS (SELECT count(*) AS n, count(o_orderkey) AS k, count(DISTINCT o_orderkey) AS u FROM s), b AS (SELECT count(*) AS n, count(o_orderkey) AS k, count(DISTINCT o_orderkey) AS u FROM t),
    c AS (SELECT 'total_rows' AS "check", a.n AS source, b.n AS target FROM a, b UNION ALL SELECT 'distinct_keys', a.u, b.u FROM a, b UNION ALL SELECT 'duplicate_rows', a.k - a.u, b.k - b.u FROM a, b)
    SELECT "check", source, target, target - source AS difference, CASE WHEN source = 0 AND target = 0 THEN 0.0 WHEN source = 0 THEN NULL ELSE round((target - source) * 100.0 / source, 2)::DOUBLE END AS percentage_difference, source = target AS matched FROM c""")
def l2_volume_checks(spark, d):
    return orders(spark, d).volume()


@query(f"WITH t AS ({perturb.LINEITEM_T}) SELECT count(*) AS total_rows, count(*) AS keyed_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows, 0 AS unusable_rows FROM t")
def l2_key_stats_composite(spark, d):
    return profile.key_counts(build(spark, d, perturb.LINEITEM_T), ["l_orderkey", "l_linenumber"])


# Level 3

@query(f"{PAIRS_O} SELECT status, count(*) AS n FROM pairs GROUP BY status")
def l3_status_counts(spark, d):
    return records.status_counts(orders(spark, d).records)


@query(f"{PAIRS_O} SELECT k0, s_o_custkey AS o_custkey FROM pairs WHERE status = 'MISSING_IN_TARGET'")
def l3_missing(spark, d):
    return orders(spark, d).records.filter("status = 'MISSING_IN_TARGET'").select("k0", F.col("s.o_custkey"))


@query(f"{PAIRS_O} SELECT k0, t_o_custkey AS o_custkey FROM pairs WHERE status = 'EXTRA_IN_TARGET'")
def l3_extra(spark, d):
    return orders(spark, d).records.filter("status = 'EXTRA_IN_TARGET'").select("k0", F.col("t.o_custkey"))


@query(f"{PAIRS_O} SELECT status, coalesce(s_o_custkey, t_o_custkey) AS o_custkey, coalesce(s_o_orderdate, t_o_orderdate) AS o_orderdate FROM pairs WHERE status LIKE 'UNMATCHABLE%'")
def l3_unmatchable(spark, d):
    rows = orders(spark, d).records.filter("status LIKE 'UNMATCHABLE%'")
    return rows.select("status", F.coalesce("s.o_custkey", "t.o_custkey").alias("o_custkey"), F.coalesce("s.o_orderdate", "t.o_orderdate").alias("o_orderdate"))


@query(f"{PAIRS_L} SELECT k0, k1, max(source_key_count) AS source_rows, max(target_key_count) AS target_rows, count(*) FILTER (status = 'MATCHED') AS pairs FROM pairs GROUP BY k0, k1 HAVING max(source_key_count) > 1 OR max(target_key_count) > 1")
def l3_duplicate_rollup(spark, d):
    return records.duplicate_keys(lines(spark, d).records, 2)


@query(f"{PAIRS_L} SELECT k0, k1, status, source_key_count, target_key_count, source_ordinal, target_ordinal, s_l_partkey AS source_part, t_l_partkey AS target_part FROM pairs")
def l3_pairs_with_duplicates(spark, d):
    keep = ("k0", "k1", "status", "source_key_count", "target_key_count", "source_ordinal", "target_ordinal")
    return lines(spark, d).records.select(*keep, F.col("s.l_partkey").alias("source_part"), F.col("t.l_partkey").alias("target_part"))


@query(f"{PAIRS_ST} SELECT k0, status, source_key_count, target_key_count, source_ordinal, target_ordinal, s_o_custkey AS source_customer, t_o_custkey AS target_customer FROM pairs")
def l3_frequent_keys(spark, d):
    """Keys with up to half of all rows."""
    found = orders(spark, d, ReconSpec(keys=(("o_orderstatus", "o_orderstatus"),), hot_rows=400)).records
    return found.select("k0", "status", "source_key_count", "target_key_count", "source_ordinal", "target_ordinal", F.col("s.o_custkey").alias("source_customer"), F.col("t.o_custkey").alias("target_customer"))


COVERAGE = """, n AS (
    SELECT count(*) FILTER (status = 'MATCHED') AS matched_pairs, count(DISTINCT (k0, source_ordinal)) FILTER (status = 'MATCHED') AS matched_source,
           count(DISTINCT (k0, target_ordinal)) FILTER (status = 'MATCHED') AS matched_target, count(*) FILTER (status = 'MISSING_IN_TARGET') AS missing,
           count(*) FILTER (status = 'EXTRA_IN_TARGET') AS extra, count(*) FILTER (status = 'UNMATCHABLE_SOURCE') AS unmatchable_source,
           count(*) FILTER (status = 'UNMATCHABLE_TARGET') AS unmatchable_target, (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM t) AS target_rows FROM pairs)"""


@query(f"""{PAIRS_O} {COVERAGE} SELECT *, round(matched_source / source_rows * 100, 2) AS source_coverage_pct, round(matched_target / target_rows * 100, 2) AS target_coverage_pct, round(missing / source_rows * 100, 2) AS missing_rate_pct,
    round(extra / target_rows * 100, 2) AS extra_rate_pct, round((unmatchable_source + unmatchable_target) / (source_rows + target_rows) * 100, 2) AS ambiguous_rate_pct, 'FAIL' AS status FROM n""")
def l3_coverage_metrics(spark, d):
    return orders(spark, d).metrics("L3")


@query(f"""WITH s AS ({perturb.LINEITEM_S}), t AS ({perturb.LINEITEM_T}), a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, count(*) AS n FROM s GROUP BY ALL), b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, count(*) AS n FROM t GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, coalesce(a.n, 0) AS source_rows, coalesce(b.n, 0) AS target_rows FROM a FULL JOIN b USING (l_orderkey, l_linenumber, l_partkey, l_quantity) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def l3_rows_without_keys(spark, d):
    return records.row_level_diff(build(spark, d, perturb.LINEITEM_S), build(spark, d, perturb.LINEITEM_T), ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


UNRESOLVED = f"""{PAIRS_OL}, u AS (SELECT * FROM pairs WHERE status <> 'MATCHED'),
    sx AS (SELECT s_o_custkey AS g, s_o_totalprice AS price, lower(trim(s_o_orderpriority)) AS pri, status = 'MISSING_IN_TARGET' AS keyed FROM u WHERE status IN ('MISSING_IN_TARGET', 'UNMATCHABLE_SOURCE')),
    tx AS (SELECT t_o_custkey AS g, t_o_totalprice AS price, lower(trim(t_o_orderpriority)) AS pri, status = 'EXTRA_IN_TARGET' AS keyed FROM u WHERE status IN ('EXTRA_IN_TARGET', 'UNMATCHABLE_TARGET')),
    se AS (SELECT * FROM sx WHERE NOT keyed OR g IN (SELECT g FROM tx WHERE NOT keyed)), te AS (SELECT * FROM tx WHERE NOT keyed OR g IN (SELECT g FROM sx WHERE NOT keyed))"""


@query(f"""{UNRESOLVED}, a AS (SELECT g, count(*) AS n, bool_or(keyed) AS k FROM se GROUP BY g), b AS (SELECT g, count(*) AS n, bool_or(keyed) AS k FROM te GROUP BY g)
    SELECT g AS n0, a.n AS source_rows, b.n AS target_rows, CASE WHEN a.k <> b.k THEN 'MISSING_BUSINESS_KEY' WHEN a.k THEN 'POSSIBLE_KEY_CHANGE' ELSE 'MATCHED_BY_ATTRIBUTES' END AS secondary_status
    FROM a JOIN b USING (g) WHERE a.k <> b.k OR (a.n = 1 AND b.n = 1)""")
def l3_secondary_match(spark, d):
    return groups.secondary_match(orders(spark, d, ORDERS_GROUPED).records, ORDERS_GROUPED)


def grouped_sql(s: str, t: str) -> str:
    def side(x: str, n: str) -> str:
        return f"""{n}m AS (SELECT g, arg_min(pri, (-n, pri)) AS m FROM (SELECT g, pri, count(*) AS n FROM {x} WHERE pri IS NOT NULL GROUP BY g, pri) GROUP BY g),
        {n}g AS (SELECT x.g, count(*) AS n, sum(price) AS a0, any_value(m.m) AS a1 FROM {x} x LEFT JOIN {n}m m ON m.g = x.g GROUP BY x.g)"""

    return f"""{side(s, 'p')}, {side(t, 'q')}, j AS (
        SELECT coalesce(p.g, q.g) AS g0, coalesce(p.n, 0) AS source_rows, coalesce(q.n, 0) AS target_rows, p.n IS NOT NULL AND q.n IS NOT NULL AS both_sides, p.a0 AS sa0, q.a0 AS ta0, p.a1 AS s_a1, q.a1 AS t_a1 FROM pg p FULL JOIN qg q ON p.g = q.g),
        gr AS (SELECT *, both_sides AND source_rows <> target_rows AS row_count_failed, both_sides AND (source_rows > 1 OR target_rows > 1) AS duplicate_failed,
               both_sides AND sa0 IS DISTINCT FROM ta0 AS v0, both_sides AND s_a1 IS DISTINCT FROM t_a1 AS v1 FROM j)"""


GROUPED_STATUS = """CASE WHEN target_rows = 0 THEN 'MISSING_GROUP_IN_TARGET' WHEN source_rows = 0 THEN 'EXTRA_GROUP_IN_TARGET' WHEN row_count_failed THEN 'GROUP_ROW_COUNT_MISMATCH'
    WHEN duplicate_failed THEN 'GROUP_DUPLICATE_ROWS' WHEN v0 OR v1 THEN 'GROUP_VALUE_MISMATCH' ELSE 'PASS' END"""


@query(f"{UNRESOLVED}, {grouped_sql('se', 'te')} SELECT g0, source_rows, target_rows, sa0 AS s_a0, ta0 AS t_a0, s_a1, t_a1, {GROUPED_STATUS} AS group_status FROM gr")
def l3_group_recon(spark, d):
    found = groups.fallback_groups(orders(spark, d, ORDERS_GROUPED).records, ORDERS_GROUPED)
    return found.select("g0", "source_rows", "target_rows", "s_a0", "t_a0", "s_a1", "t_a1", "group_status")


@query(f"""{UNRESOLVED}, {grouped_sql('se', 'te')}, n AS (SELECT count(*) FILTER (source_rows > 0) AS source_groups, count(*) FILTER (target_rows > 0) AS target_groups, count(*) FILTER (both_sides) AS common_groups,
    count(*) FILTER (target_rows = 0) AS missing_groups, count(*) FILTER (source_rows = 0) AS extra_groups, count(*) FILTER (row_count_failed) AS row_count_failed, count(*) FILTER (duplicate_failed) AS duplicate_failed,
    count(*) FILTER (row_count_failed OR duplicate_failed OR v0 OR v1) AS mismatch_groups FROM gr)
    SELECT *, round(common_groups / source_groups * 100, 2) AS source_coverage_pct, 'FAIL' AS status FROM n""")
def l3_group_summary(spark, d):
    row = groups.group_summary(groups.fallback_groups(orders(spark, d, ORDERS_GROUPED).records, ORDERS_GROUPED))
    return row.select("source_groups", "target_groups", "common_groups", "missing_groups", "extra_groups", "row_count_failed", "duplicate_failed", "mismatch_groups", "source_coverage_pct", "status")


@query(f"""{UNRESOLVED}, {grouped_sql('se', 'te')}
    SELECT g0, 'GROUP_PRESENCE' AS check_name, CASE WHEN source_rows > 0 THEN 'PRESENT' ELSE 'ABSENT' END AS source_value, CASE WHEN target_rows > 0 THEN 'PRESENT' ELSE 'ABSENT' END AS target_value, CASE WHEN both_sides THEN 'PASS' ELSE 'FAIL' END AS status FROM gr
    UNION ALL SELECT g0, 'ROW_COUNT', source_rows::VARCHAR, target_rows::VARCHAR, CASE WHEN row_count_failed THEN 'FAIL' ELSE 'PASS' END FROM gr WHERE both_sides
    UNION ALL SELECT g0, 'DUPLICATE_ROWS', source_rows::VARCHAR, target_rows::VARCHAR, 'FAIL' FROM gr WHERE both_sides AND duplicate_failed
    UNION ALL SELECT g0, 'SUM(o_totalprice)', sa0::VARCHAR, ta0::VARCHAR, CASE WHEN v0 THEN 'FAIL' ELSE 'PASS' END FROM gr WHERE both_sides AND (sa0 IS NOT NULL OR ta0 IS NOT NULL)
    UNION ALL SELECT g0, 'MODE(o_orderpriority)', s_a1, t_a1, CASE WHEN v1 THEN 'FAIL' ELSE 'PASS' END FROM gr WHERE both_sides AND (s_a1 IS NOT NULL OR t_a1 IS NOT NULL)""")
def l3_group_evidence(spark, d):
    found = groups.fallback_groups(orders(spark, d, ORDERS_GROUPED).records, ORDERS_GROUPED)
    return groups.evidence_rows(found, BY_CUSTOMER)


@query("SELECT p_brand, arg_min(p_type, (-n, p_type)) AS mode FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
def group_mode(spark, d):
    return groups.mode(spark.read.parquet(f"{d}/part.parquet").select("p_brand", "p_type"), ["p_brand"], "p_type")


# Level 4

def cells(pairs: str, names: dict[str, str], where: dict[str, str] | None = None, keys: str = "k0") -> str:
    """SQL of the cells that differ; ``where``: another condition for a column."""
    parts = []
    for c, gap in names.items():
        bad = (where or {}).get(c, f"s_{c} IS DISTINCT FROM t_{c}")
        parts.append(f"SELECT {keys}, source_ordinal, target_ordinal, '{c}' AS source_column, {gap.replace('@s', 's_' + c).replace('@t', 't_' + c)} AS difference FROM pairs WHERE status = 'MATCHED' AND ({bad})")
    return f"{pairs} {' UNION ALL '.join(parts)}"


GAP, NONE = "CAST(CAST(@t AS DOUBLE) - CAST(@s AS DOUBLE) AS DOUBLE)", "CAST(NULL AS DOUBLE)"
ORDER_GAPS = {"o_custkey": GAP, "o_orderstatus": NONE, "o_totalprice": GAP, "o_orderdate": NONE, "o_orderpriority": NONE}
CUSTOMER_GAPS = {"c_name": NONE, "c_nationkey": GAP, "c_acctbal": GAP, "c_mktsegment": NONE}
LINE_GAPS = {"l_partkey": GAP, "l_suppkey": GAP, "l_quantity": GAP, "l_extendedprice": GAP, "l_returnflag": NONE, "l_shipdate": NONE}
CELL = ("source_ordinal", "target_ordinal", "source_column", "difference")


@query(cells(PAIRS_O, ORDER_GAPS))
def l4_exact(spark, d):
    return orders(spark, d).mismatches().select("k0", *CELL)


@query(cells(PAIRS_OL, ORDER_GAPS, {"o_orderpriority": "lower(trim(s_o_orderpriority)) IS DISTINCT FROM lower(trim(t_o_orderpriority))"}))
def l4_normalized_trim_lower(spark, d):
    return orders(spark, d, ORDERS_LOOSE).mismatches().select("k0", *CELL)


@query(cells(PAIRS_C, CUSTOMER_GAPS, {"c_mktsegment": "nullif(trim(s_c_mktsegment), '') IS DISTINCT FROM nullif(trim(t_c_mktsegment), '')"}))
def l4_empty_as_null(spark, d):
    return customers(spark, d, customers_as("c_mktsegment", "segment", {"empty_as_null": True})).mismatches().select("k0", *CELL)


@query(cells(PAIRS_C, CUSTOMER_GAPS | {"c_acctbal": "round(CAST(@t AS DOUBLE), 0) - round(CAST(@s AS DOUBLE), 0)"}, {"c_acctbal": "round(CAST(s_c_acctbal AS DOUBLE), 0) <> round(CAST(t_c_acctbal AS DOUBLE), 0)"}))
def l4_round(spark, d):
    return customers(spark, d, customers_as("c_acctbal", "balance", {"round": 0})).mismatches().select("k0", *CELL)


@query(cells(PAIRS_C, CUSTOMER_GAPS, {"c_acctbal": "abs(CAST(t_c_acctbal AS DOUBLE) - CAST(s_c_acctbal AS DOUBLE)) > 0.01"}))
def l4_abs_tolerance(spark, d):
    return customers(spark, d, customers_as("c_acctbal", "balance", tolerance=0.01)).mismatches().select("k0", *CELL)


@query(cells(PAIRS_C, CUSTOMER_GAPS, {"c_acctbal": "abs(CAST(t_c_acctbal AS DOUBLE) - CAST(s_c_acctbal AS DOUBLE)) > abs(CAST(s_c_acctbal AS DOUBLE)) * 0.05"}))
def l4_pct_tolerance(spark, d):
    return customers(spark, d, customers_as("c_acctbal", "balance", tolerance=0.0, tolerance_pct=5.0)).mismatches().select("k0", *CELL)


@query(f"{PAIRS_C} " + " UNION ALL ".join(f"SELECT '{c}' AS source_column, count(*) AS compared, count(*) FILTER (s_{c} IS DISTINCT FROM t_{c}) AS mismatches, round((count(*) - count(*) FILTER (s_{c} IS DISTINCT FROM t_{c})) / count(*) * 100, 2) AS conformity_pct FROM pairs WHERE status = 'MATCHED'" for c in CUSTOMER_GAPS))
def l4_field_stats(spark, d):
    return customers(spark, d).field_stats()


@query(cells(PAIRS_L, LINE_GAPS, keys="k0, k1"))
def l4_duplicate_pairs(spark, d):
    return lines(spark, d).mismatches().select("k0", "k1", *CELL)


@query(f"""{PAIRS_O}, m AS (SELECT k0, ({' + '.join(f"CAST(s_{c} IS DISTINCT FROM t_{c} AS INTEGER)" for c in ORDER_GAPS)}) AS n FROM pairs WHERE status = 'MATCHED'), k AS (SELECT k0, count(*) AS p, sum(n) AS n FROM m GROUP BY k0),
    r AS (SELECT CAST(sum(p) AS BIGINT) AS matched_pairs, CAST(sum(n) AS BIGINT) AS mismatches, count(*) FILTER (n > 0) AS keys_with_mismatch FROM k)
    SELECT *, matched_pairs * 5 AS compared, round((matched_pairs * 5 - mismatches) / (matched_pairs * 5) * 100, 2) AS conformity_pct, round(keys_with_mismatch / matched_pairs * 100, 2) AS affected_pct, 'FAIL' AS status FROM r""")
def l4_metrics(spark, d):
    return orders(spark, d).metrics("L4")


@query("SELECT c_custkey, sha256(concat('1', length(trim(c_name)), ':', trim(lower(c_name)), CASE WHEN c_mktsegment = '' THEN '0' ELSE concat('1', length(c_mktsegment), ':', c_mktsegment) END)) AS row_hash FROM (" + perturb.CUSTOMER_S + ")")
def l4_row_hash(spark, d):
    s = build(spark, d, perturb.CUSTOMER_S)
    return s.select("c_custkey", fields.row_hash(s, [("c_name", LOOSE), ("c_mktsegment", {"empty_as_null": True})]).alias("row_hash"))


# Level 5

def by_group(name: str, function: str, column: str | None, group: tuple[str, ...] = (), **more) -> AggregateRule:
    return AggregateRule(name, function, column, column, group, group, **more)


def checks(r: Reconciliation, *rules: AggregateRule) -> DataFrame:
    found = aggregates.aggregate_checks(r.source, r.target, rules)
    return found.select("rule", F.array_join("group", ",").alias("group"), F.round("source_value", 2).alias("source_value"), F.round("target_value", 2).alias("target_value"), "matched")


def check_sql(rule: str, expression: str, ok: str, group: str = "", head: str = S_AND_T) -> str:
    g = f"{group} AS g" if group else "'' AS g"
    by = f"GROUP BY {group}" if group else ""
    return f"""{head}, a AS (SELECT {g}, {expression} AS v FROM s {by}), b AS (SELECT {g}, {expression} AS v FROM t {by})
    SELECT '{rule}' AS rule, CAST(coalesce(a.g, b.g) AS VARCHAR) AS "group", round(CAST(a.v AS DOUBLE), 2) AS source_value, round(CAST(b.v AS DOUBLE), 2) AS target_value, coalesce(a.g IS NOT NULL AND b.g IS NOT NULL AND {ok}, false) AS matched FROM a FULL JOIN b ON a.g = b.g"""


EQUAL = "a.v IS NOT DISTINCT FROM b.v"


@query(check_sql("total", "sum(o_totalprice)", EQUAL) + " UNION ALL SELECT * FROM (" + check_sql("mean", "CAST(sum(o_custkey) AS DOUBLE) / count(o_custkey)", EQUAL) + ")")
def l5_global(spark, d):
    return checks(orders(spark, d), by_group("total", "SUM", "o_totalprice"), by_group("mean", "AVG", "o_custkey"))


@query(check_sql("by_status", "sum(o_totalprice)", EQUAL, "o_orderstatus"))
def l5_grouped(spark, d):
    return checks(orders(spark, d), by_group("by_status", "SUM", "o_totalprice", ("o_orderstatus",)))


@query(check_sql("near", "sum(o_totalprice)", "abs(b.v - a.v) <= abs(a.v) * 0.2", "o_custkey"))
def l5_grouped_tolerance(spark, d):
    return checks(orders(spark, d), by_group("near", "SUM", "o_totalprice", ("o_custkey",), tolerance_pct=20.0))


@query(check_sql("rows", "count(*)", "abs(b.v - a.v) <= 3", "o_orderpriority"))
def l5_count_star(spark, d):
    return checks(orders(spark, d), by_group("rows", "COUNT", None, ("o_orderpriority",), tolerance=3.0))


@query(check_sql("low", "min(o_totalprice)", EQUAL) + " UNION ALL SELECT * FROM (" + check_sql("last", "epoch(max(o_orderdate))", EQUAL) + ")")
def l5_minmax(spark, d):
    return checks(orders(spark, d), by_group("low", "MIN", "o_totalprice"), by_group("last", "MAX", "o_orderdate"))


@query(f"""{C_AND_T}, a AS (SELECT count(c_mktsegment) AS v, count(*) FILTER (c_mktsegment IS NULL OR c_mktsegment = '') AS n FROM s), b AS (SELECT count(segment) AS v, count(*) FILTER (segment IS NULL OR segment = '') AS n FROM t)
    SELECT r AS rule, CAST(a.v AS DOUBLE) AS source_value, CAST(b.v AS DOUBLE) AS target_value, a.n AS source_nulls, b.n AS target_nulls, abs(b.v - a.v) <= greatest(x, a.v * y / 100) AS matched FROM a, b, (VALUES ('exact', 0, 0), ('rows', 3, 0), ('either', 1, 12)) AS w(r, x, y)""")
def l5_null_counts(spark, d):
    r = customers(spark, d)
    rules = [AggregateRule(n, "COUNT", "c_mktsegment", "segment", tolerance=t) for n, t in (("exact", None), ("rows", 3), ("either", {"absolute": 1, "percentage": 12}))]
    return aggregates.aggregate_checks(r.source, r.target, tuple(rules)).select("rule", "source_value", "target_value", "source_nulls", "target_nulls", "matched")


# Level 6

def quality_sql(rule: str, conditions: dict[str, str], head: str) -> str:
    return head + " " + " UNION ALL ".join(f"SELECT '{rule}' AS rule, '{'SOURCE' if x == 's' else 'TARGET'}' AS side, count(*) AS total, count(*) FILTER ({c}) AS failed, round((count(*) - count(*) FILTER ({c})) / count(*) * 100, 2) AS pass_pct FROM {x}" for x, c in conditions.items())


def quality_of(r: Reconciliation, *rules: QualityRule) -> DataFrame:
    return quality.quality_checks(r.source, r.target, rules)


@query(quality_sql("name", {"s": "NOT regexp_matches(c_name, '^Customer#[0-9]+$')", "t": "NOT regexp_matches(full_name, '^Customer#[0-9]+$')"}, C_AND_T))
def l6_pattern(spark, d):
    return quality_of(customers(spark, d), QualityRule("name", "PATTERN", "c_name", "full_name", regex="^Customer#[0-9]+$"))


@query(quality_sql("segment", {"s": "c_mktsegment IS NULL OR trim(c_mktsegment) = ''", "t": "segment IS NULL OR trim(segment) = ''"}, C_AND_T))
def l6_completeness(spark, d):
    return quality_of(customers(spark, d), QualityRule("segment", "COMPLETENESS", "c_mktsegment", "segment"))


@query(quality_sql("priority", {"s": "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", "t": "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"}, S_AND_T))
def l6_validity_set(spark, d):
    return quality_of(orders(spark, d), QualityRule("priority", "VALIDITY", "o_orderpriority", "o_orderpriority", allowed=("1-URGENT", "2-HIGH")))


@query(quality_sql("price", {"s": "NOT coalesce(o_totalprice BETWEEN 1000 AND 250000, false)"}, S_AND_T))
def l6_validity_range(spark, d):
    return quality_of(orders(spark, d), QualityRule("price", "VALIDITY", "o_totalprice", apply_to="SOURCE", minimum=1000, maximum=250000))


@query(f"""{C_AND_T}, q AS (SELECT (SELECT count(*) FILTER (c_mktsegment IS NULL OR trim(c_mktsegment) = '') / count(*) FROM s) AS a, (SELECT count(*) FILTER (segment IS NULL OR trim(segment) = '') / count(*) FROM t) AS b)
    SELECT 'segment' AS rule, round(a * 100, 2) AS source_rate, round(b * 100, 2) AS target_rate, abs(round(b * 100, 2) - round(a * 100, 2)) <= 5 AS matched FROM q""")
def dq_rate_comparison(spark, d):
    found = quality_of(customers(spark, d), QualityRule("segment", "COMPLETENESS", "c_mktsegment", "segment"))
    return quality.rate_comparison(found, 5.0)


@query("SELECT (SELECT count(*) FROM lineitem WHERE lower(trim(l_returnflag)) <> lower(trim(l_linestatus))) AS source_failed, (SELECT count(*) FROM nation WHERE n_nationkey <> n_regionkey) AS target_failed, (SELECT count(*) FROM lineitem WHERE lower(trim(l_returnflag)) <> lower(trim(l_linestatus))) = (SELECT count(*) FROM nation WHERE n_nationkey <> n_regionkey) AS matched")
def dq_consistency(spark, d):
    return quality.consistency(spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/nation.parquet"), ["l_returnflag", "l_linestatus"], ["n_nationkey", "n_regionkey"])


@query("""WITH x AS (SELECT epoch(max(ts)) AS a FROM events), y AS (SELECT epoch(max(ts)) AS b FROM events WHERE event_id % 3 = 0)
    SELECT round(a, 3) AS source_latest, round(b, 3) AS target_latest, round(abs(b - a), 3) AS latency_seconds, abs(b - a) <= 60 AS matched FROM x, y""")
def dq_timeliness(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    row = quality.timeliness(e, e.filter("event_id % 3 = 0"), "ts", "ts", 60.0)
    return row.select(*(F.round(c, 3).alias(c) for c in ("source_latest", "target_latest", "latency_seconds")), "matched")


@query("SELECT s_nationkey AS value, count(*) AS rows FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 4 <> 0) GROUP BY s_nationkey")
def dq_referential(spark, d):
    return quality.referential(spark.read.parquet(f"{d}/supplier.parquet"), spark.read.parquet(f"{d}/nation.parquet").filter("n_nationkey % 4 <> 0"), "s_nationkey", "n_nationkey")


@query(f"""{C_AND_T}, a AS (SELECT c_mktsegment AS v, count(*) / (SELECT count(*) FROM s) * 100 AS p FROM s GROUP BY 1), b AS (SELECT segment AS v, count(*) / (SELECT count(*) FROM t) * 100 AS p FROM t GROUP BY 1),
    j AS (SELECT coalesce(a.v, b.v) AS value, coalesce(round(a.p, 4), 0) AS source_pct, coalesce(round(b.p, 4), 0) AS target_pct FROM a FULL JOIN b ON a.v IS NOT DISTINCT FROM b.v)
    SELECT *, round(abs(target_pct - source_pct), 4) AS difference, round(abs(target_pct - source_pct), 4) <= 1 AS matched FROM j""")
def dq_distribution(spark, d):
    r = customers(spark, d)
    return quality.distribution(r.source, r.target, "c_mktsegment", "segment", 1.0)


@query("SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS applicable, count(*) FILTER (c_mktsegment = 'BUILDING' AND NOT c_acctbal > 0) AS failed FROM customer")
def dq_conditional(spark, d):
    return quality.conditional(spark.read.parquet(f"{d}/customer.parquet"), "c_mktsegment", "BUILDING", "c_acctbal", "POSITIVE")


@query(f"{C_AND_T} SELECT count(*) AS pairs, count(*) FILTER (upper(c_name) IS DISTINCT FROM full_name) AS failed FROM s JOIN t ON c_custkey = id")
def dq_transformation(spark, d):
    r = customers(spark, d)
    return quality.transformation(r.source, r.target, [("c_custkey", "id")], "c_name", "full_name", "UPPER").select("pairs", "failed")


@query(f"{S_AND_T}, v AS (SELECT (SELECT CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM s) AS source_value, (SELECT CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM t) AS target_value) SELECT *, round((target_value - source_value) / source_value * 100, 2) AS change_pct, abs(target_value - source_value) <= 5 AS matched FROM v")
def dq_scalar_pair(spark, d):
    r = orders(spark, d)
    return quality.scalar_pair(r.source, r.target, "count(DISTINCT o_custkey)", "count(DISTINCT o_custkey)", 5.0)


@query(f"""{C_AND_T}, a AS (SELECT count(*) FILTER (NOT coalesce(c_acctbal BETWEEN 0 AND 8000, false)) AS f, count(*) AS n FROM s), b AS (SELECT count(*) FILTER (NOT coalesce(balance BETWEEN 0 AND 8000, false)) AS f, count(*) AS n FROM t),
    v AS (SELECT a.f AS source_failed, b.f AS target_failed, round(a.f / a.n * 100, 2) AS source_rate, round(b.f / b.n * 100, 2) AS target_rate FROM a, b)
    SELECT 'rows' AS rule, *, abs(target_failed - source_failed) <= 5 AS matched FROM v UNION ALL SELECT 'rate', *, abs(target_rate - source_rate) <= 2 AS matched FROM v
    UNION ALL SELECT 'source', source_failed, NULL, source_rate, NULL, source_rate <= 40 FROM v""")
def dq_validity_tolerance(spark, d):
    ranges = {"minimum": 0, "maximum": 8000}
    rules = (
        QualityRule("rows", "VALIDITY", "c_acctbal", "balance", tolerance=5, **ranges), QualityRule("rate", "VALIDITY", "c_acctbal", "balance", tolerance={"percentage": 2}, **ranges),
        QualityRule("source", "VALIDITY", "c_acctbal", apply_to="SOURCE", tolerance={"percentage": 40, "absolute": 1}, **ranges),
    )
    return quality.quality_verdicts(quality_of(customers(spark, d), *rules), rules)


@query(f"{C_AND_T} SELECT c_custkey FROM s WHERE c_mktsegment IS NULL OR trim(c_mktsegment) = ''")
def dq_failing_rows(spark, d):
    return quality.failing_rows(customers(spark, d).source, QualityRule("segment", "COMPLETENESS", "c_mktsegment", "segment"), "c_mktsegment").select("c_custkey")


# Across levels

@query(f"""{PAIRS_O}, n AS (SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM s) AS volume_difference, count(*) FILTER (status = 'EXTRA_IN_TARGET') - count(*) FILTER (status = 'MISSING_IN_TARGET') AS record_difference,
    count(*) FILTER (status = 'UNMATCHABLE_TARGET') - count(*) FILTER (status = 'UNMATCHABLE_SOURCE') AS keyless_difference,
    (SELECT count(*) FROM t1 WHERE k0 IN (SELECT k0 FROM s1)) - (SELECT count(*) FROM s1 WHERE k0 IN (SELECT k0 FROM t1)) AS surplus_difference FROM pairs)
    SELECT *, volume_difference = record_difference + keyless_difference + surplus_difference AS explained FROM n""")
def l7_volume_record(spark, d):
    r = orders(spark, d)
    return correlate.volume_record(r.metrics("L2"), r.metrics("L3"))


@query(f"""{PAIRS_C}, a AS (SELECT round(sum(CAST(t_c_acctbal AS DECIMAL(38,6)) - s_c_acctbal), 4) AS field_delta FROM pairs WHERE status = 'MATCHED'), b AS (SELECT (SELECT sum(balance) FROM t) - (SELECT sum(c_acctbal) FROM s) AS x)
    SELECT 'balance' AS rule, 'c_acctbal' AS source_column, CAST(field_delta AS DOUBLE) AS field_delta, round(CAST(x AS DOUBLE), 4) AS aggregate_difference, abs(field_delta - x) < 1e-6 AS explained FROM a, b""")
def l7_field_aggregate(spark, d):
    r = customers(spark, d)
    found = aggregates.aggregate_checks(r.source, r.target, (AggregateRule("balance", "SUM", "c_acctbal", "balance"),))
    out = correlate.field_aggregate(r.mismatches(), found, {"balance": "c_acctbal"})
    return out.withColumns({c: F.round(c, 4) for c in ("field_delta", "aggregate_difference")})


@query(f"{PAIRS_C}, n AS (SELECT count(*) FILTER (s_c_nationkey IS DISTINCT FROM t_c_nationkey) AS a, count(*) FILTER (s_c_acctbal IS DISTINCT FROM t_c_acctbal) AS b FROM pairs WHERE status = 'MATCHED') SELECT 'c_acctbal' AS source_column, 'DATA_TYPE_CHANGED' AS drift, b AS mismatches FROM n WHERE b > 0 UNION ALL SELECT 'c_nationkey', 'DATA_TYPE_CHANGED', a FROM n WHERE a > 0")
def l7_schema_field(spark, d):
    r = customers(spark, d)
    return correlate.schema_field(r.schema(), r.field_stats())


def rollup_sql(pairs: str, schema: str, nulls: str, cells: str, keys: tuple[str, str]) -> str:
    return f"""{pairs}, l AS (
        SELECT 'L1' AS level, {schema} AS ok UNION ALL SELECT 'L2', (SELECT count(*) FROM s) = (SELECT count(*) FROM t) AND (SELECT count(DISTINCT {keys[0]}) FROM s) = (SELECT count(DISTINCT {keys[1]}) FROM t) AND {nulls}
        UNION ALL SELECT 'L3', NOT EXISTS (SELECT * FROM pairs WHERE status <> 'MATCHED') UNION ALL SELECT 'L4', NOT EXISTS (SELECT * FROM pairs WHERE status = 'MATCHED' AND ({cells})))
    SELECT count(*) AS levels, count(*) FILTER (NOT ok) AS failed_levels, CASE WHEN bool_or(NOT ok AND level IN ('L2', 'L3')) THEN 'CRITICAL' WHEN bool_or(NOT ok) THEN 'HIGH' ELSE 'INFO' END AS severity,
           CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END AS status FROM l"""


LEVELS_1_TO_4 = ("L1", "L2", "L3", "L4")
ANY_CELL = " OR ".join(f"s_{c} IS DISTINCT FROM t_{c}" for c in CUSTOMER_GAPS)


@query(rollup_sql(PAIRS_C, "false", "(SELECT count(c_mktsegment) - count(*) FROM s) = (SELECT count(segment) - count(*) FROM t)", ANY_CELL, ("c_custkey", "id")))
def run_rollup(spark, d):
    return customers(spark, d, replace(CUSTOMERS, levels=LEVELS_1_TO_4)).rollup()


@query(rollup_sql(PAIRS_CC, "true", "true", ANY_CELL, ("c_custkey", "c_custkey")))
def run_rollup_of_equals(spark, d):
    s = build(spark, d, perturb.CUSTOMER_S)
    return Reconciliation(s, s, ReconSpec(keys=(("c_custkey", "c_custkey"),), levels=LEVELS_1_TO_4)).rollup()


@query("""WITH r AS (SELECT o_custkey AS run_id, o_orderpriority AS task_id, epoch(o_orderdate) * 1000000 + o_orderkey AS created_at, o_orderkey AS result FROM orders), d AS (SELECT DISTINCT o_custkey AS run_id, o_orderpriority AS task_id FROM orders WHERE o_orderstatus = 'F')
    SELECT run_id, task_id, arg_max(result, created_at) AS result FROM r JOIN d USING (run_id, task_id) GROUP BY run_id, task_id""")
def latest_of_runs(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    named = [F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("task_id")]
    results = o.select(*named, (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")).alias("created_at"), F.col("o_orderkey").alias("result"))
    tasks = o.select(*named, F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("FAILED").alias("state"))
    return latest_results(results, tasks).select("run_id", "task_id", "result")


@query(cells(PAIRS_O, ORDER_GAPS) + " ORDER BY k0, source_ordinal, target_ordinal, source_column LIMIT 50 OFFSET 50")
def report_page(spark, d):
    return written(spark, d).page("mismatches", "a", 2, 50).select("k0", *CELL)


REPORT = ["k0", "source_ordinal", "target_ordinal", "source_column"]


def written(spark: SparkSession, d: str, times: int = 1) -> Results:
    """The cells of the orders that differ, as a run in a folder of its own."""
    out = Results(spark, shared_dir(spark))
    for _ in range(times):
        out.put(orders(spark, d).mismatches(), "mismatches", "a", REPORT)
    return out


@query(cells(PAIRS_O, ORDER_GAPS))
def sink_retry(spark, d):
    """Written twice, each cell is there once."""
    return written(spark, d, 2).read("mismatches", "a").select("k0", *CELL)


@query(cells(PAIRS_O, ORDER_GAPS) + " ORDER BY k0, source_ordinal, target_ordinal, source_column LIMIT 60 OFFSET 120")
def report_seek(spark, d):
    """The third page, each sought from the last row of the one before."""
    results, row = written(spark, d), None
    for _ in range(2):
        row = results.after("mismatches", "a", row, 60).agg(F.max("row")).first()[0]
    return results.after("mismatches", "a", row, 60).select("k0", *CELL)


@query(f"SELECT * FROM ({cells(PAIRS_O, ORDER_GAPS)}) WHERE k0 >= 5000 ORDER BY k0, source_ordinal, target_ordinal, source_column LIMIT 40")
def report_from_key(spark, d):
    return written(spark, d).from_key("mismatches", "a", {"k0": 5000}, 40).select("k0", *CELL)


@query(f"WITH m AS ({cells(PAIRS_O, ORDER_GAPS)}) SELECT k0, source_column, (SELECT count(*) FROM m) AS total FROM m ORDER BY k0, source_ordinal, target_ordinal, source_column LIMIT 30")
def evidence_count(spark, d):
    rows, total = evidence(orders(spark, d).mismatches(), REPORT, 30)
    return spark.createDataFrame([(r["k0"], r["source_column"], total) for r in rows], "k0 long, source_column string, total long")


RUN_STATUS = "CASE WHEN NOT EXISTS (SELECT * FROM pairs WHERE status <> 'MATCHED') THEN 'PASS' ELSE 'FAIL' END"


@query(f"""{PAIRS_O} SELECT 'second' AS run_id, 'DONE' AS state, TIMESTAMP '2024-01-02 00:00:00' AS created_at, 1 AS levels, CAST({RUN_STATUS} = 'FAIL' AS INTEGER) AS failed_levels, {RUN_STATUS} AS status
    UNION ALL SELECT 'first', 'DONE', TIMESTAMP '2024-01-01 00:00:00', 1, CAST(NOT EXISTS (SELECT * FROM pairs WHERE k0 < 0) AS INTEGER) - 1, 'PASS'
    UNION ALL SELECT 'broken', 'RUNNING', TIMESTAMP '2024-01-03 00:00:00', NULL, NULL, NULL""")
def run_history(spark, d):
    """A run that passed, one that failed, one that broke off."""
    out, spec = Results(spark, shared_dir(spark)), replace(ORDERS, levels=("L3",))
    s = build(spark, d, perturb.CUSTOMER_S)
    out.write(Reconciliation(s, s, ReconSpec(keys=(("c_custkey", "c_custkey"),), levels=("L3",))), "first", datetime(2024, 1, 1, tzinfo=timezone.utc))
    out.write(orders(spark, d, spec), "second", datetime(2024, 1, 2, tzinfo=timezone.utc))
    out.state("broken", "RUNNING", datetime(2024, 1, 3, tzinfo=timezone.utc), "")
    return out.runs().drop("spec").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("SELECT o_custkey AS run_id, count(*) AS levels, count(*) FILTER (o_orderstatus = 'F') AS failed_levels, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'FAIL' ELSE 'PASS' END AS status FROM orders GROUP BY o_custkey")
def runs(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("PASS")
    return run_listing(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("level"), status.alias("status")))


# Sources

@query("SELECT n_nationkey, n_name, n_regionkey, n_regionkey = 1 AS flag, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey / 4 END AS share, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (n_nationkey) DAY AS at FROM nation")
def source_csv(spark, d):
    path, n = shared_dir(spark), spark.read.parquet(f"{d}/nation.parquet")
    flag = F.when(F.col("n_regionkey") == 1, "Yes").otherwise("no")
    share = F.when(F.col("n_nationkey") % 5 != 0, F.format_string("%.2f", F.col("n_nationkey") / 4))
    n.select("n_nationkey", "n_name", "n_regionkey", flag.alias("flag"), share.alias("share"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey")).cast("string").alias("at")).write.option("header", True).csv(path)
    return readers.default_registry().read(spark, "CSV", {"path": path}).withColumns({"share": F.col("share").cast("double"), "at": F.col("at").cast("timestamp_ntz")})


@query("SELECT f AS format, r_regionkey, r_name FROM region, (VALUES ('parquet'), ('orc'), ('json'), ('table')) AS x(f)")
def source_formats(spark, d):
    known, region = readers.default_registry(), spark.read.parquet(f"{d}/region.parquet")
    region.createOrReplaceTempView("congruity_region")
    out = known.read(spark, "table", {"name": "congruity_region"}).select(F.lit("table").alias("format"), "r_regionkey", "r_name")
    for name in ("parquet", "orc", "json"):
        path = shared_dir(spark)
        region.write.format(name).save(path)
        out = out.unionByName(known.read(spark, name, {"path": path}).select(F.lit(name).alias("format"), F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name"))
    return out


@query("""SELECT row_number() OVER () - 1 AS ordinal, column_name AS "column", CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS type FROM (DESCRIBE SELECT * FROM customer)""")
def source_schema(spark, d):
    return readers.describe(spark.read.parquet(f"{d}/customer.parquet")).select("ordinal", "column", "type")


@query(f"WITH t AS ({perturb.CUSTOMER_T}) SELECT count(*) AS rows, 6 AS columns, 4 AS numeric, 2 AS text, 0 AS temporal, CAST(count(*) > count(segment) AS INTEGER) AS with_nulls FROM t")
def source_analysis(spark, d):
    return readers.analyze(build(spark, d, perturb.CUSTOMER_T))


@query("""SELECT 'customer' AS name, true AS opens, (SELECT count(*) FROM (DESCRIBE SELECT * FROM customer)) AS columns UNION ALL SELECT 'nothing', false, 0 UNION ALL SELECT 'damaged', false, 0
    UNION ALL SELECT 'NATION', true, (SELECT count(*) FROM (DESCRIBE SELECT * FROM nation)) UNION ALL SELECT 'MISSING', false, 0""")
def source_test(spark, d):
    """Tables that are there, that are not, and one whose schema is given but whose file
    is no Parquet; of files and of a database."""
    known, broken, p = readers.default_registry(), shared_dir(spark), derby(spark, d, "nation")
    spark.read.parquet(f"{d}/region.parquet").select("r_name").write.text(broken)
    asked = [
        ("customer", "parquet", {"path": f"{d}/customer.parquet"}), ("nothing", "parquet", {"path": f"{d}/nothing.parquet"}), ("damaged", "parquet", {"path": broken, "schema": "id long"}),
        ("NATION", "jdbc", p | {"table": "NATION"}), ("MISSING", "jdbc", p | {"table": "MISSING"}),
    ]
    found = [(n, *known.test(spark, reader, q)) for n, reader, q in asked]
    return spark.createDataFrame([(n, ok, len(why.split(", ")) if ok else 0) for n, ok, why in found], "name string, opens boolean, columns long")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1995-03-01' AND o_orderdate < TIMESTAMP '1997-01-01 12:00:00'")
def filter_dates_in_text(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("string").alias("at"))
    return filters.apply_filters(o, (RowFilter("at", ">=", date(1995, 3, 1)), RowFilter("at", "<", datetime(1997, 1, 1, 12)))).select("o_orderkey")


# Streams, over tables

@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS \"start\", time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    return as_moments(events.window_counts(stream(spark, d), "ts", "1 hour", "1 hour", by=("event_type",)))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER o <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
    SELECT min(ts) AS "start", max(ts) + INTERVAL 3 HOUR AS "end", user_id, count(*) AS n FROM g GROUP BY user_id, session""")
def stream_sessions(spark, d):
    return as_moments(events.sessions(stream(spark, d), "ts", "1 hour", "3 hours", "user_id"))


def stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def as_moments(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


# Samples

#: Strata of l_linenumber: about so many rows of each; smaller ones are read whole.
SAMPLE_ROWS, SAMPLE_SEED = 1500, 7
DRAWN = "CAST('0x' || substr(md5('{seed}' || chr(10) || l_orderkey || chr(10) || l_linenumber), 1, 8) AS BIGINT)".format(seed=SAMPLE_SEED)
SAMPLE_SQL = f"""WITH s AS ({perturb.LINEITEM_S}), t AS ({perturb.LINEITEM_T}), n AS (
        SELECT l_linenumber AS h, count(*) FILTER (own = 's') AS source_rows, count(*) FILTER (own = 't') AS target_rows
        FROM (SELECT l_linenumber, 's' AS own FROM s WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL UNION ALL SELECT l_linenumber, 't' FROM t WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL) GROUP BY 1
    ), r AS (SELECT *, ceil(least(1.0::DOUBLE, {SAMPLE_ROWS}.0::DOUBLE / greatest(source_rows, target_rows)) * 4294967296) AS cut FROM n
    ), a AS (SELECT s.* FROM s JOIN r ON r.h = l_linenumber AND {DRAWN} < cut
    ), b AS (SELECT t.* FROM t JOIN r ON r.h = l_linenumber AND {DRAWN} < cut)"""


@query(f"{SAMPLE_SQL} SELECT 'source' AS side, l_orderkey, l_linenumber FROM a UNION ALL SELECT 'target', l_orderkey, l_linenumber FROM b")
def sample_members(spark, d):
    r = lines(spark, d)
    s, t, _ = sampling.sample_sides(r.source, r.target, LINES, SAMPLE_ROWS, ("l_linenumber",), SAMPLE_SEED)
    return s.select(F.lit("source").alias("side"), "l_orderkey", "l_linenumber").unionByName(t.select(F.lit("target").alias("side"), "l_orderkey", "l_linenumber"))


LINE_NAMES = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
LINE_CELLS = ", ".join(LINE_NAMES)


@query(f"""{SAMPLE_SQL}, a1 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_CELLS}) AS o, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM a
    ), b1 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_CELLS}) AS o, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM b
    ), k AS (
        SELECT a1.l_orderkey, a1.l_linenumber AS h, count(*) AS xs, count(*) FILTER (b1.o IS NOT NULL) AS covered,
               count(*) FILTER (b1.o IS NOT NULL AND ({" OR ".join(f"a1.{c} IS DISTINCT FROM b1.{c}" for c in LINE_NAMES)})) AS differing, 0 AS xt, 0 AS extra
        FROM a1 LEFT JOIN b1 ON a1.l_orderkey = b1.l_orderkey AND a1.l_linenumber = b1.l_linenumber AND b1.o = CASE WHEN a1.o <= b1.c THEN a1.o ELSE 1 END GROUP BY 1, 2
        UNION ALL SELECT b.l_orderkey, b.l_linenumber, 0, 0, 0, count(*), count(*) FILTER (a2.l_orderkey IS NULL) FROM b LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM a) a2 USING (l_orderkey, l_linenumber) GROUP BY 1, 2
    ), e AS (
        SELECT h, metric, sum(y) AS y, sum(x) AS x, sum(x::DOUBLE * x) AS xx
        FROM (SELECT h, 'coverage' AS metric, covered AS y, xs AS x FROM k UNION ALL SELECT h, 'mismatch', differing, xs FROM k UNION ALL SELECT h, 'extra', extra, xt FROM k) GROUP BY ALL
    ), p AS (
        SELECT metric, CASE WHEN metric = 'extra' THEN target_rows ELSE source_rows END AS n, cut >= 4294967296 AS exact, coalesce(x, 0) AS seen,
               CASE WHEN x > 0 THEN y / x ELSE 0.5 END AS p, CASE WHEN x > 0 THEN (1 - cut / 4294967296) * xx / (x::DOUBLE * x) ELSE 1e9 END AS d, 1.959963984540054 AS z
        FROM r JOIN e USING (h)
    ), w AS (
        SELECT *, greatest((p + z * z * d / 2 - z * sqrt(p * (1 - p) * d + z * d * z * d / 4)) / (1 + z * z * d), 0) AS low, least((p + z * z * d / 2 + z * sqrt(p * (1 - p) * d + z * d * z * d / 4)) / (1 + z * z * d), 1) AS high FROM p WHERE n > 0
    )
    SELECT metric, round(sum(n * p) / sum(n), 6) AS estimate, round(greatest(sum(n * p) / sum(n) - sqrt(sum(pow(n * (p - low), 2))) / sum(n), 0), 6) AS lower,
           round(least(sum(n * p) / sum(n) + sqrt(sum(pow(n * (high - p), 2))) / sum(n), 1), 6) AS upper,
           CAST(sum(n) AS BIGINT) AS population, CAST(sum(seen) AS BIGINT) AS sampled_rows, count(*) AS strata, count(*) FILTER (exact) AS exact_strata
    FROM w GROUP BY metric""")
def sample_bounds(spark, d):
    found = lines(spark, d).sampled(SAMPLE_ROWS, ("l_linenumber",), SAMPLE_SEED)
    return found.withColumns({c: F.round(c, 6) for c in ("estimate", "lower", "upper")})


# Checksums

ALL_LINES = ("l_orderkey", "l_linenumber", *LINE_NAMES)
DIFFERENT_LINES = f"""WITH s AS (SELECT {', '.join(ALL_LINES)}, count(*) AS n FROM ({perturb.LINEITEM_S}) GROUP BY ALL), t AS (SELECT {', '.join(ALL_LINES)}, count(*) AS n FROM ({perturb.LINEITEM_T}) GROUP BY ALL)
    SELECT {', '.join(f'coalesce(s.{c}, t.{c}) AS {c}' for c in ALL_LINES)}, coalesce(s.n, 0) AS source_rows, coalesce(t.n, 0) AS target_rows
    FROM s FULL JOIN t ON {' AND '.join(f's.{c} IS NOT DISTINCT FROM t.{c}' for c in ALL_LINES)} WHERE s.n IS DISTINCT FROM t.n"""


@query(DIFFERENT_LINES)
def checksum_by_hash(spark, d):
    r = lines(spark, d)
    return checksum.checksum_diff(r.source, r.target, list(ALL_LINES))


@query(f"WITH s AS ({perturb.ORDERS_S}), t AS (SELECT * FROM s WHERE o_orderkey IS NULL OR o_orderkey NOT BETWEEN 4000 AND 4100) SELECT *, 1 AS source_rows, 0 AS target_rows FROM s WHERE o_orderkey BETWEEN 4000 AND 4100")
def checksum_by_range(spark, d):
    s = build(spark, d, perturb.ORDERS_S)
    return checksum.checksum_diff(s, s.filter("o_orderkey IS NULL OR o_orderkey NOT BETWEEN 4000 AND 4100"), s.columns, "o_orderkey")


# Databases

def derby(spark: SparkSession, d: str, *names: str) -> dict:
    """The named tables in a database in the shared folder, for reading by every process.

    A Derby directory belongs to one process, and one in memory is seen by no other. So
    the database is filled here, by its own import of files that Spark wrote, and packed
    into an archive, which any number of processes may read at once."""
    folder = shared_dir(spark)
    require(re.match("(file:|/)", folder) is not None, "an embedded database needs a shared folder that is mounted as files")
    local = Path(re.sub("^file:/*", "/", folder))
    p = {"url": f"jdbc:derby:{local}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    as_text = {"escape": '"', "dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    for name in names:
        rows = spark.read.parquet(f"{d}/{name}.parquet")
        jdbc.write_jdbc(spark.createDataFrame([], rows.schema), p | {"table": name, "text": "VARCHAR(200)"})
        rows.write.options(**as_text).csv(f"{folder}/{name}")
        database = spark._jvm.java.sql.DriverManager.getConnection(p["url"])
        for file in sorted(local.glob(f"{name}/part-*")):
            database.createStatement().execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{name.upper()}', '{file}', NULL, NULL, 'UTF-8', 0)")
        database.close()
    with suppress(Py4JJavaError):  # a shutdown ends by an exception
        spark._jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{local}/db;shutdown=true")
    with ZipFile(local / "db.jar", "w") as archive:
        for file in sorted(x for x in (local / "db").rglob("*") if x.is_file() and x.suffix != ".lck"):
            archive.write(file, file.relative_to(local))
    return p | {"url": f"jdbc:derby:jar:({local}/db.jar)db"}


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderstatus = 'F'")
def source_jdbc(spark, d):
    p = derby(spark, d, "orders") | {"table": "orders", "column": "o_orderkey", "partitions": 8}
    o = readers.default_registry().read(spark, "jdbc", p)
    return filters.apply_filters(o, (RowFilter("o_orderkey", ">=", 100), RowFilter("o_orderstatus", "=", "F"))).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_mktsegment, count(*) AS n, max(c_custkey) AS last FROM customer WHERE c_nationkey < 12 GROUP BY c_mktsegment")
def source_jdbc_query(spark, d):
    p = derby(spark, d, "customer") | {"query": 'SELECT "c_custkey", "c_mktsegment" FROM customer WHERE "c_nationkey" < 12', "column": "c_custkey", "partitions": 4}
    return readers.default_registry().read(spark, "JDBC", p).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("last"))


@query(f"{PAIRS_C} SELECT status, count(*) AS n FROM pairs GROUP BY status")
def l3_over_jdbc(spark, d):
    """Records of a database table against files."""
    p = derby(spark, d, "customer") | {"table": "customer", "column": "c_custkey", "partitions": 4}
    names = [f.name for f in spark.read.parquet(f"{d}/customer.parquet").schema.fields]
    source = readers.default_registry().read(spark, "jdbc", p).toDF(*names)
    source = source.withColumns({"c_acctbal": F.col("c_acctbal").cast("decimal(18,2)"), "c_mktsegment": F.when(F.col("c_custkey") % 29 == 0, "").otherwise(F.col("c_mktsegment"))})
    return records.status_counts(Reconciliation(source, build(spark, d, perturb.CUSTOMER_T), CUSTOMERS).records)


@query("SELECT name, 'BASE TABLE' AS type, n AS rows FROM (SELECT 'NATION' AS name, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'REGION', (SELECT count(*) FROM region))")
def source_discovery(spark, d):
    """Tables that a database has, and their rows."""
    p = derby(spark, d, "nation", "region")
    found = jdbc.discover(spark, p).filter("table_schema = 'APP'").orderBy("table_name").collect()
    out = [jdbc.read_jdbc(spark, p | {"table": r["table_name"]}).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(r["table_name"]).alias("name"), F.lit(r["table_type"]).alias("type"), "rows") for r in found]
    return reduce(DataFrame.unionByName, out)


# Footers and distributions

@query("""SELECT 'o_orderkey' AS "column", count(*) AS rows, count(*) - count(o_orderkey) AS nulls, min(o_orderkey)::VARCHAR AS low, max(o_orderkey)::VARCHAR AS high FROM orders
    UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey), min(o_custkey)::VARCHAR, max(o_custkey)::VARCHAR FROM orders
    UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), NULL, NULL FROM orders UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority), NULL, NULL FROM orders""")
def source_footers(spark, d):
    names = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return footers.footer_statistics(spark, f"{d}/orders.parquet").filter(F.col("column").isin(*names)).drop("type")


BALANCES = [0.0, 1000.0, 2500.0, 4000.0, 6000.0, 8000.0]
BINS_SQL = f"""{C_AND_T}, x AS (SELECT c_acctbal::DOUBLE AS x, 's' AS own FROM s UNION ALL SELECT CASE WHEN id % 5 = 0 THEN NULL ELSE balance * 1.2 END::DOUBLE, 't' FROM t),
    c AS (SELECT CASE WHEN x IS NULL THEN -1 ELSE {' + '.join(f'(x >= {b})::INTEGER' for b in BALANCES)} END AS bin, count(*) FILTER (own = 's') AS s, count(*) FILTER (own = 't') AS t FROM x GROUP BY 1),
    b AS (SELECT bin, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(-1, {len(BALANCES) + 1}) AS r(bin) LEFT JOIN c USING (bin)),
    v AS (SELECT bin, s, t, s / sum(s) OVER () AS p, t / sum(t) OVER () AS q, greatest(s, 0.5) / sum(s) OVER () AS ps, greatest(t, 0.5) / sum(t) OVER () AS qs,
          abs(sum(t) OVER (ORDER BY bin) / sum(t) OVER () - sum(s) OVER (ORDER BY bin) / sum(s) OVER ()) AS ks FROM b WHERE bin >= 0)"""


def balance_bins(spark, d):
    r = customers(spark, d)
    target = r.target.withColumn("balance", F.when(F.col("id") % 5 != 0, F.col("balance").cast("double") * 1.2))
    return quality.numeric_distribution(r.source, target, "c_acctbal", "balance", BALANCES)


@query(f"{BINS_SQL} SELECT bin, s AS source_rows, t AS target_rows, round(p, 6) AS source_share, round(q, 6) AS target_share, round((qs - ps) * ln(qs / ps), 6) AS psi, round(ks, 6) AS ks FROM v UNION ALL SELECT bin, s, t, NULL, NULL, NULL, NULL FROM b WHERE bin = -1")
def dq_numeric_bins(spark, d):
    return balance_bins(spark, d).drop("low", "high").withColumns({c: F.round(c, 6) for c in ("source_share", "target_share", "psi", "ks")})


@query(f"""{BINS_SQL} SELECT round(sum((qs - ps) * ln(qs / ps)), 6) AS psi, round(max(ks), 6) AS ks, (SELECT round((sum(t) FILTER (bin < 0) / sum(t) - sum(s) FILTER (bin < 0) / sum(s)) * 100, 4) FROM b) AS null_difference,
    sum((qs - ps) * ln(qs / ps)) <= 0.1 AND max(ks) <= 0.1 AS matched FROM v""")
def dq_numeric_shift(spark, d):
    row = quality.distribution_shift(balance_bins(spark, d))
    return row.select(F.round("psi", 6).alias("psi"), F.round("ks", 6).alias("ks"), F.round("null_difference", 4).alias("null_difference"), "matched")


# Streams, from files to tables

def arriving(spark: SparkSession, events: DataFrame, parts: int, again: bool = False) -> str:
    """A folder in which the events arrive by time in so many files, with the rows of the
    file before once more in ``again``; a last event lets all watermarks pass."""
    path, ends = shared_dir(spark), events.agg(F.min("ts"), F.max("ts")).first()
    width = (ends[1] - ends[0]) / parts
    for k in range(parts + 1):
        first = ends[0] + width * (k - 1 if again else k)
        kept = events.filter((F.col("ts") >= first) & (F.col("ts") < ends[0] + width * (k + 1))) if k < parts else events.filter(F.col("ts") >= ends[0] + width * parts)
        kept.coalesce(1).write.mode("append").parquet(path)
    events.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(ends[1] + timedelta(days=400)).alias("ts")).coalesce(1).write.mode("append").parquet(path)
    return path


EVENTS = "event_id long, ts timestamp"
SHIFTED = "ts + INTERVAL 2 MINUTES * (event_id % 4)"


@query(f"""WITH s AS (SELECT event_id, ts FROM events WHERE event_id % 5 <> 0), t AS (SELECT event_id, {SHIFTED.replace('INTERVAL 2 MINUTES * (event_id % 4)', 'INTERVAL (2 * (event_id % 4)) MINUTE')} AS ts FROM events WHERE event_id % 7 <> 0)
    SELECT coalesce(s.event_id, t.event_id) AS event_id, s.ts AS source_time, t.ts AS target_time, CASE WHEN t.event_id IS NULL THEN 'MISSING_IN_TARGET' WHEN s.event_id IS NULL THEN 'EXTRA_IN_TARGET' ELSE 'MATCHED' END AS status
    FROM s FULL JOIN t ON s.event_id = t.event_id AND t.ts BETWEEN s.ts - INTERVAL 5 MINUTE AND s.ts + INTERVAL 5 MINUTE""")
def stream_match(spark, d):
    """Two streams of files, joined across batches; what finds no partner comes out once
    the watermarks have passed it."""
    e, out, state = stream(spark, d).select("event_id", "ts"), shared_dir(spark), shared_dir(spark)
    sides = e.filter("event_id % 5 <> 0"), e.filter("event_id % 7 <> 0").withColumn("ts", F.expr(SHIFTED))
    s, t = (runs_of.file_stream(spark, arriving(spark, x, 3), EVENTS, files=1) for x in sides)
    runs_of.run_available(events.match(s, t, "event_id", "ts", "10 minutes", "5 MINUTES"), out, state)
    found = spark.read.parquet(out).filter("event_id >= 0")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("source_time", "target_time")})


@query("SELECT event_id, ts FROM events")
def stream_first_seen(spark, d):
    """Every event arrives twice, in two files, and is kept once; the second run goes on
    from the state of the first."""
    e, out, state = stream(spark, d).select("event_id", "ts"), shared_dir(spark), shared_dir(spark)
    arrived = runs_of.file_stream(spark, arriving(spark, e, 3, again=True), EVENTS, files=2)
    for _ in range(2):
        runs_of.run_available(events.first_seen(arrived, ["event_id"], "ts", "300 days"), out, state)
    return spark.read.parquet(out).filter("event_id >= 0").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# Profiles that add up

@query("""SELECT 'o_custkey' AS "column", count(*) AS rows, count(*) - count(o_custkey) AS nulls, min(o_custkey)::DOUBLE AS low, max(o_custkey)::DOUBLE AS high, NULL AS low_text, NULL AS high_text, count(DISTINCT o_custkey) AS exact, true AS near, true AS median_near FROM orders
    UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice), min(o_totalprice)::DOUBLE, max(o_totalprice)::DOUBLE, NULL, NULL, count(DISTINCT o_totalprice), true, true FROM orders
    UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority), NULL, NULL, min(o_orderpriority), max(o_orderpriority), count(DISTINCT o_orderpriority), true, NULL FROM orders""")
def profile_of_parts(spark, d):
    """Profiles of each year, kept as a table and merged: exact rows, nulls and ends;
    distinct values within 3 %, the median within 2 % of the ranks, of the exact ones."""
    o, path = spark.read.parquet(f"{d}/orders.parquet").withColumn("year", F.year("o_orderdate")), shared_dir(spark)
    names = ["o_custkey", "o_totalprice", "o_orderpriority"]
    sketches.column_profiles(o, names, ("year",)).write.parquet(path)
    found = sketches.in_numbers(sketches.merged(spark.read.parquet(path)))
    exact = o.agg(*(F.count_distinct(c).alias(c) for c in names))
    exact = exact.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in names))).alias("x")).select("x.*")
    both = found.join(exact, "column")
    medians = both.select(F.map_from_entries(F.collect_list(F.struct("column", F.col("quantiles")[1].alias("m"))).over(Window.partitionBy())).alias("m")).limit(1)
    below = o.join(medians, F.lit(True)).agg(*(F.avg((F.col(c).cast("double") <= F.col("m")[c]).cast("double")).alias(c) for c in names[:2]))
    below = below.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.abs(F.col(c) - 0.5) <= 0.02).alias("median_near")) for c in names[:2]))).alias("x")).select("x.*")
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.col("exact") * 0.03
    return both.join(below, "column", "left").select("column", "rows", "nulls", "low", "high", "low_text", "high_text", "exact", near.alias("near"), "median_near")
