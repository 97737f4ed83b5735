"""Row filters as predicates that reach the scan."""

from __future__ import annotations

import operator
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, every, kind
from ..spec import RowFilter, require

#: Places behind the point of numbers in text that are compared exactly.
PLACES = 18
COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def predicate(f: RowFilter, t: T.DataType | None = None, null_is_unequal: bool = False) -> Column:
    """SQL's three-valued logic; with ``null_is_unequal`` a null is unequal to any value.

    Text (``t`` a string type) compared with a number, date or moment is read as one
    where it is one, and is null where it is not.
    """
    c = col(f.field)
    if f.operator == "IS NULL":
        return c.isNull()
    if f.operator == "IS NOT NULL":
        return c.isNotNull()
    values = f.value if f.operator == "IN" else (f.value,)

    def compared(c: Column, some: tuple) -> Column:
        if f.operator == "IN":
            return c.isin(*some)
        if f.operator == "!=" and null_is_unequal:
            return ~c.eqNullSafe(F.lit(some[0]))
        return COMPARE[f.operator](c, F.lit(some[0]))

    if isinstance(t, T.StringType) and all(isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) for v in values):
        rough = compared(c.try_cast("double"), tuple(map(float, values)))
        if any(isinstance(v, float) for v in values):
            return rough
        # Whole and decimal numbers are compared exactly where the text is one that 38 digits hold.
        exact = c.try_cast(T.DecimalType(38, PLACES))
        return F.when(exact.isNotNull(), compared(exact, tuple(map(Decimal, values)))).otherwise(rough)
    if isinstance(t, T.StringType) and values and all(isinstance(v, date) for v in values):
        c = c.try_cast("timestamp" if any(isinstance(v, datetime) for v in values) else "date")
    return compared(c, values)


def apply_filters(df: DataFrame, filters: tuple[RowFilter, ...], null_is_unequal: bool = False) -> DataFrame:
    for f in filters:
        require(f.field in df.columns, f"no column {f.field}")
    return df.filter(every([predicate(f, kind(df, f.field), null_is_unequal) for f in filters])) if filters else df
