"""Level 3 without keys, by a tree of checksums.

Each row has two hashes of 64 bits. A bucket of rows is known by their number and the
sums of the hashes, which do not depend on the order of rows, tell repeated rows apart
from single ones, and add up from bucket to bucket: from the leaves to the root. Two
sides are compared from the root down, and only buckets that differ are descended. The
rows of the leaves that differ, and no others, are then shuffled and compared as they
are. Equal rows have equal hashes, so no difference is invented; unequal buckets pass
for equal with a chance of about 2 ** -112.

Leaves are ranges of the first hash, or ranges of a column: these reach the scan as
predicates, so that files and row groups of equal ranges are not read again. The
digests of a side that does not change can be kept and used again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, comparable, every, exact_type, is_numeric, kind, normalize, normalized_type, some
from ..spec import Mapping, require

#: Leaves are 2 ** BITS, children of a bucket 2 ** FANOUT; predicates of a scan at most; levels
#: above the leaves.
BITS, FANOUT, RANGES = 16, 4, 32
LEVELS = BITS // FANOUT
SUMS = ("low", "high", "low2", "high2")
DIGESTS = "level int, bucket long, n long, " + ", ".join(f"{s} decimal(38,0)" for s in SUMS)


def canonical(source: DataFrame, target: DataFrame, pairs: list[Mapping]) -> tuple[list[Column], list[Column]]:
    """The compared columns of either side in common types, so that equal values have
    equal hashes."""
    mine, theirs = [], []
    for m in pairs:
        how, st, tt = m.normalization, kind(source, m.source), kind(target, m.target)
        a, b = comparable(normalize(col(m.source), st, how), normalized_type(st, how), normalize(col(m.target), tt, how), normalized_type(tt, how))
        if st != tt and is_numeric(st) and is_numeric(tt) and "round" not in how:
            common = exact_type(st, tt) or T.DoubleType()
            a, b = a.cast(common), b.cast(common)
        mine.append(a)
        theirs.append(b)
    return mine, theirs


def hashes(columns: list[Column]) -> tuple[Column, Column]:
    """Two hashes of a row. A null leaves Spark's hash as it was, so it is said which
    columns are null."""
    nulls = F.array(*(c.isNull() for c in columns))
    return F.xxhash64(*columns, nulls), F.xxhash64(F.lit(0x5BD1E995), nulls, *columns)


def leaf_of_hash(one: Column) -> Column:
    return F.shiftrightunsigned(one, 64 - BITS)


def as_number(c: Column, t: T.DataType) -> Column:
    return F.unix_date(c).cast("long") if isinstance(t, T.DateType) else c.cast("long")


def leaf_of_range(c: Column, low: int, width: int) -> Column:
    """Ranges of equal width; what lies outside goes to the first or last one, null to
    the first."""
    return F.when(c.isNull(), 0).otherwise(F.greatest(F.least(F.floor((c - low) / width), F.lit((1 << BITS) - 1)), F.lit(0))).cast("long")


def digest_leaves(rows: DataFrame) -> DataFrame:
    """bucket, n and sums, from rows with leaf, one, two: one narrow aggregate. Halves of
    hashes are summed, as whole ones would pass a long."""
    half = (1 << 32) - 1
    parts = {"low": F.col("one").bitwiseAND(F.lit(half)), "high": F.shiftrightunsigned("one", 32), "low2": F.col("two").bitwiseAND(F.lit(half)), "high2": F.shiftrightunsigned("two", 32)}
    return rows.groupBy(F.col("leaf").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).cast("decimal(38,0)").alias(n) for n, c in parts.items()))


def tree(leaves: DataFrame) -> DataFrame:
    """level, bucket, n and sums: level 0 is the root, the last one the leaves. At most
    (16 / 15) * 2 ** BITS rows, whatever the table. One aggregate adds the leaves to all
    buckets above them."""
    path = F.array(*(F.struct(F.lit(level).alias("level"), F.shiftright("bucket", BITS - FANOUT * level).alias("bucket")) for level in range(LEVELS)))
    above = leaves.select(F.inline(path), "n", *SUMS).groupBy("level", "bucket").agg(F.sum("n").alias("n"), *(F.sum(s).cast("decimal(38,0)").alias(s) for s in SUMS))
    # Said again, so that a plan that asks for the leaves alone is without the levels above.
    return above.filter(F.col("level") < LEVELS).unionByName(leaves.withColumn("level", F.lit(LEVELS)))


def unequal(source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    s, t = (x.select(*by, F.struct("n", *SUMS).alias(own)) for x, own in ((source, "s"), (target, "t")))
    return s.join(t, by, "full").filter(~F.col("s").eqNullSafe(F.col("t"))).select(*by)


def descend(source: DataFrame, target: DataFrame) -> DataFrame:
    """bucket: the leaves of two trees that differ, as all buckets above them do. The levels
    above are compared at once: a bucket that differs stands for all parents of leaves below
    it, and a parent that every level has is descended."""
    last = F.col("level") == LEVELS
    above = unequal(source.filter(~last), target.filter(~last), ["level", "bucket"])
    width = f"{BITS - FANOUT} - {FANOUT} * CAST(level AS int)"
    below = above.selectExpr(f"explode(sequence(shiftleft(bucket, {width}), shiftleft(bucket + 1, {width}) - 1)) AS parent")
    parents = below.groupBy("parent").agg(F.count(F.lit(1)).alias("levels")).filter(F.col("levels") == LEVELS).select("parent")
    return unequal(source.filter(last), target.filter(last), ["bucket"]).join(F.broadcast(parents), F.shiftright("bucket", FANOUT) == F.col("parent"), "left_semi")


class Checksums:
    """A comparison of two sides by the columns of ``pairs``; ``by`` names a column of
    whole numbers or dates, by source, whose ranges are the leaves."""

    def __init__(self, source: DataFrame, target: DataFrame, pairs: list[Mapping], by: str | None = None, bounds: tuple[int, int] | None = None):
        require(pairs, "checksums need columns")
        self.sides, self.pairs, self.by = (source, target), pairs, by
        self.columns = canonical(source, target, pairs)
        if by is not None:
            named = {m.source: m.target for m in pairs}
            require(by in named, f"{by} is not compared")
            self.names = (by, named[by])
            self.kinds = tuple(kind(df, n) for df, n in zip(self.sides, self.names, strict=True))
            require(all(isinstance(t, (T.IntegralType, T.DateType)) for t in self.kinds) and len({isinstance(t, T.DateType) for t in self.kinds}) == 1, f"{by} has no ranges")
            low, high = bounds or self.ends()
            self.low, self.width = low, max(1, -(-(high - low + 1) // (1 << BITS)))

    def ends(self) -> tuple[int, int]:
        """The least and largest value of ``by`` on either side; Parquet has them in its
        footers."""
        row = reduce(DataFrame.unionByName, (df.select(as_number(col(n), t).alias("x")) for df, n, t in zip(self.sides, self.names, self.kinds, strict=True))).agg(F.min("x"), F.max("x")).first()
        return row[0] or 0, row[1] or 0

    def rows(self, side: int) -> DataFrame:
        """c0.., leaf, one, two of a side."""
        columns = self.columns[side]
        one, two = hashes([F.col(f"c{i}") for i in range(len(columns))])
        leaf = leaf_of_hash(F.col("one")) if self.by is None else leaf_of_range(F.col("x"), self.low, self.width)
        x = F.lit(None).cast("long") if self.by is None else as_number(col(self.names[side]), self.kinds[side])
        named = self.sides[side].select(*(c.alias(f"c{i}") for i, c in enumerate(columns)), x.alias("x"))
        return named.withColumns({"one": one, "two": two}).withColumn("leaf", leaf).drop("x")

    def digests(self, side: int) -> DataFrame:
        """The tree of a side (columns of DIGESTS), to be kept or compared at once."""
        return tree(digest_leaves(self.rows(side)))

    def differing(self, source: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
        """bucket: leaves that differ. Kept digests of the same columns and leaves may
        stand for a side."""
        return descend(self.digests(0) if source is None else source, self.digests(1) if target is None else target)

    def within(self, side: int, leaves: list[int]) -> Column:
        """A predicate on the column of the ranges: the nearest ones are taken together
        until at most RANGES are left."""
        spans = [(k, k) for k in leaves]
        if len(spans) > 1:
            gaps = sorted((b - a for a, b in zip(leaves, leaves[1:], strict=False)), reverse=True)
            wide = max(1, gaps[RANGES - 1] if len(gaps) >= RANGES else 1)
            spans = []
            for k in leaves:
                if spans and k - spans[-1][1] <= wide:
                    spans[-1] = (spans[-1][0], k)
                else:
                    spans.append((k, k))
        c, last = col(self.names[side]), (1 << BITS) - 1
        date = isinstance(self.kinds[side], T.DateType)

        def value(x: int) -> Column:
            return F.date_from_unix_date(F.lit(x)) if date else F.lit(x)

        out = []
        for a, b in spans:
            ends = ([c >= value(self.low + a * self.width)] if a > 0 else []) + ([c < value(self.low + (b + 1) * self.width)] if b < last else [])
            out.append(every(ends) | c.isNull() if a == 0 else every(ends))
        return some(out)

    def difference(self, source: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
        """Rows (columns named as in the source) whose number differs, with source_rows
        and target_rows. The leaves that differ are at most 2 ** BITS numbers."""
        leaves = self.differing(source, target)
        sides = list(self.sides)
        if self.by is not None:
            found = sorted(r["bucket"] for r in leaves.collect())
            leaves = self.sides[0].sparkSession.createDataFrame([(k,) for k in found], "bucket long")
            self.sides = tuple(df.filter(self.within(k, found)) for k, df in enumerate(sides))
        kept = [self.rows(k).join(F.broadcast(leaves), F.col("leaf") == F.col("bucket"), "left_semi").drop("leaf", "one", "two") for k in (0, 1)]
        self.sides = tuple(sides)
        cs = [f"c{i}" for i in range(len(self.pairs))]
        both = kept[0].withColumn("own", F.lit(1)).unionByName(kept[1].withColumn("own", F.lit(0)))
        counted = both.groupBy(*cs).agg(F.sum("own").alias("source_rows"), F.sum(1 - F.col("own")).alias("target_rows")).filter("source_rows != target_rows")
        return counted.select(*(F.col(f"c{i}").alias(m.source) for i, m in enumerate(self.pairs)), "source_rows", "target_rows")


def checksum_diff(source: DataFrame, target: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """What row_level_diff() gives, by checksums."""
    return Checksums(source, target, [Mapping(c, c) for c in columns], by).difference()
