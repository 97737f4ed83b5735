"""Column builders: names, normalisation, keys, types, tolerances, rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import Mapping


def col(name: str, of: str | None = None) -> Column:
    """A column by its literal name, dots and all; ``of`` names an alias or struct."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def some(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def number(c: Column, t: T.DataType) -> Column:
    """As a double, null where there is none; moments as seconds since 1970."""
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("double") * 86400
    if is_temporal(t):
        return F.unix_micros(c.cast("timestamp")).cast("double") / 1e6
    return c.try_cast("double") if isinstance(t, T.StringType) else c.cast("double") if is_numeric(t) else F.lit(None).cast("double")


def normalize(c: Column, t: T.DataType, how: dict) -> Column:
    """empty_as_null, then trim, then case_insensitive, then round."""
    if not how:
        return c
    text = isinstance(t, T.StringType)
    if how.get("empty_as_null"):
        c = F.when(F.trim(c.cast("string")) == "", F.lit(None)).otherwise(c) if text else c
    if how.get("trim") and text:
        c = F.trim(c)
    if how.get("case_insensitive") and text:
        c = F.lower(c)
    if "round" in how:
        c = F.round(number(c, t), how["round"])
    return c


def normalized_type(t: T.DataType, how: dict) -> T.DataType:
    return T.DoubleType() if "round" in how else t


def comparable(a: Column, at: T.DataType, b: Column, bt: T.DataType) -> tuple[Column, Column]:
    """Both sides in one type: as they are, as numbers, as moments, else as text."""
    if at == bt:
        if isinstance(at, T.MapType):
            return F.array_sort(F.map_entries(a)), F.array_sort(F.map_entries(b))
        return a, b
    if is_numeric(at) and is_numeric(bt):
        return a, b  # Spark widens numbers without loss of rows
    if is_temporal(at) and is_temporal(bt):
        return a.cast("timestamp"), b.cast("timestamp")
    return tuple(c.cast("string") if isinstance(t, T.AtomicType) else F.to_json(c) for c, t in ((a, at), (b, bt)))


def usable(columns: list[str]) -> Column:
    """Whether every part of a key is there and not blank."""
    return every([col(c).isNotNull() & (F.trim(col(c).cast("string")) != "") for c in columns])


def exact_type(a: T.DataType, b: T.DataType) -> T.DecimalType | None:
    """A decimal for the differences of two whole or decimal types."""
    digits = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
    sizes = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (digits.get(type(t)), 0) for t in (a, b)]
    if any(whole is None for whole, _ in sizes):
        return None
    whole, scale = max(w for w, _ in sizes) + 1, max(n for _, n in sizes)
    return T.DecimalType(min(whole + scale, 38), scale)


def gap(s: Column, st: T.DataType, t: Column, tt: T.DataType) -> Column:
    """target less source as a double; whole numbers and decimals are subtracted exactly
    (where 38 digits hold them)."""
    rough, exact = number(t, tt) - number(s, st), exact_type(st, tt)
    return F.coalesce(F.try_subtract(t.try_cast(exact), s.try_cast(exact)).cast("double"), rough) if exact else rough


def within(s: Column, t: Column, st: T.DataType, tt: T.DataType, m: Mapping) -> Column:
    """Whether two values match: equal (nulls too), or within the tolerance, where
    both are numbers and the percentage goes before the absolute one."""
    a, b = comparable(s, st, t, tt)
    same = a.eqNullSafe(b)
    if m.comparison == "REGEX":
        return F.coalesce(s.cast("string").rlike(m.regex) & t.cast("string").rlike(m.regex), F.lit(False))
    if not (is_numeric(st) and is_numeric(tt)) or m.tolerance is None and m.tolerance_pct is None:
        return same
    limit = F.abs(s.cast("double")) * (m.tolerance_pct / 100) if m.tolerance_pct is not None else F.lit(float(m.tolerance))
    return same | F.coalesce(F.abs(gap(s, st, t, tt)) <= limit, F.lit(False))


def rate_pct(n: Column, d: Column, zero: float | None = 0.0) -> Column:
    """n / d in per cent to two places; ``zero`` where d is 0."""
    return F.when(n.isNull() | d.isNull(), F.lit(None).cast("double")).when(d == 0, F.lit(zero).cast("double")).otherwise(F.round(n / d * 100, 2))


def percent_change(s: Column, t: Column) -> Column:
    return F.when((s == 0) & (t == 0), 0.0).when(s == 0, F.lit(None).cast("double")).otherwise(F.round((t - s) / s * 100, 2))
