"""Level 3 and 4 from a sample: how many records match and agree, with bounds.

A key is in the sample or not by a hash of its parts under a seed, so both sides keep
the same keys and nothing is matched in vain. Rates are set for each stratum (parts of
the key) so that about as many rows of each come in; strata no larger than that are read
whole, and count exactly. Every row of a sampled key stands for 1 / rate rows.

The bounds are Wilson's for each stratum, with the variance that sampling whole keys
gives, joined over the strata by their weights (each stratum's distance from its bound,
squared). A stratum that was read whole adds nothing to their width.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, every, usable
from ..spec import ReconSpec, require
from .fields import mismatches_of
from .records import EXTRA, MATCHED, MISSING, key_columns, reconcile_records

#: The share of 2 ** 32 hashes that is kept has so many steps.
STEPS = 1 << 32
#: Strata whose rates are held at once and broadcast; more are joined.
FEW = 10_000


def strata_of(spec: ReconSpec, strata: tuple[str, ...]) -> list[int]:
    """Which parts of the key the named source columns are: only these are alike on both
    sides of every pair."""
    names = [s for s, _ in spec.keys]
    require(names, "a sample needs keys")
    for s in strata:
        require(s in names, f"stratum {s} is no part of the key")
    return [names.index(s) for s in strata]


def draw(parts: list[Column], seed: int | Column) -> Column:
    """A number below STEPS for a key, the same in every engine that has MD5: the first
    32 bits of the digest of the seed and the parts as text, a line feed before each."""
    text = F.concat((F.lit(seed) if isinstance(seed, int) else seed).cast("string"), *(x for p in parts for x in (F.lit("\n"), p.cast("string"))))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def stratum_counts(source: DataFrame, target: DataFrame, spec: ReconSpec, strata: tuple[str, ...]) -> DataFrame:
    """h0.., source_rows, target_rows with usable keys: one narrow aggregate a side."""
    at = strata_of(spec, strata)
    hs = [f"h{i}" for i in range(len(at))]

    def side(df: DataFrame, parts: list[Column], raw: list[str], own: str) -> DataFrame:
        return df.filter(usable(raw)).select(*(parts[k].alias(h) for k, h in zip(at, hs, strict=True)), F.lit(own).alias("side"))

    mine, theirs = key_columns(source, target, spec)
    both = side(source, mine, [s for s, _ in spec.keys], "s").unionByName(side(target, theirs, [t for _, t in spec.keys], "t"))
    return both.groupBy(*hs).agg(*(F.count_if(F.col("side") == x).alias(n) for x, n in (("s", "source_rows"), ("t", "target_rows"))))


def rates(counts: DataFrame, rows: int) -> DataFrame:
    """``counts`` with rate and cut: keys whose number is below cut are in the sample."""
    rate = F.least(F.lit(1.0), F.lit(float(rows)) / F.greatest("source_rows", "target_rows"))
    cut = F.ceil(rate * STEPS)
    return counts.withColumn("cut", cut).withColumn("rate", F.col("cut") / STEPS)


def sampled(df: DataFrame, parts: list[Column], raw: list[str], at: list[int], rated: DataFrame, seed: int) -> DataFrame:
    """Rows of ``df`` with a usable key that is in the sample."""
    named = df.filter(usable(raw)).withColumns({f"h{i} {seed}": parts[k] for i, k in enumerate(at)} | {f"n {seed}": draw(parts, seed)})
    kept = rated.select(*(F.col(f"h{i}").alias(f"r{i} {seed}") for i in range(len(at))), F.col("cut").alias(f"cut {seed}"))
    same = every([col(f"h{i} {seed}").eqNullSafe(col(f"r{i} {seed}")) for i in range(len(at))])
    inside = col(f"n {seed}") < col(f"cut {seed}")
    return named.join(kept, same & inside).select(*(col(c) for c in df.columns))


def sample_sides(source: DataFrame, target: DataFrame, spec: ReconSpec, rows: int, strata: tuple[str, ...] = (), seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides' rows of the sampled keys, and the strata with their counts and rates.
    This counts the strata at once: only so is it known whether they may be broadcast."""
    at, counts = strata_of(spec, strata), stratum_counts(source, target, spec, strata)
    found = counts.limit(FEW + 1).collect()
    few = len(found) <= FEW
    rated = rates(F.broadcast(source.sparkSession.createDataFrame(found, counts.schema)) if few else counts, rows)
    mine, theirs = key_columns(source, target, spec)
    return (
        sampled(source, mine, [s for s, _ in spec.keys], at, rated, seed),
        sampled(target, theirs, [t for _, t in spec.keys], at, rated, seed),
        rated,
    )


def key_totals(records: DataFrame, spec: ReconSpec, source_columns: list[str], target_columns: list[str]) -> DataFrame:
    """k0.., and for each key: source_rows, covered (matched source rows), differing (of
    these, in a cell of their first pair), target_rows, extra."""
    ks = [f"k{i}" for i in range(len(spec.keys))]
    matched = F.col("status") == MATCHED
    own = matched & ((F.col("target_ordinal") == F.col("source_ordinal")) | (F.col("source_ordinal") > F.col("target_key_count")))
    other = matched & ((F.col("target_ordinal") == F.col("source_ordinal")) | (F.col("target_ordinal") > F.col("source_key_count")))
    differs = mismatches_of(records, spec.pairs(source_columns, target_columns)) > 0
    return records.groupBy(*ks).agg(
        F.count_if(own | (F.col("status") == MISSING)).alias("source_rows"),
        F.count_if(own).alias("covered"),
        F.count_if(own & differs).alias("differing"),
        F.count_if(other | (F.col("status") == EXTRA)).alias("target_rows"),
        F.count_if(F.col("status") == EXTRA).alias("extra"),
    )


#: What is estimated: the rows that count, and the rows of which they are a share.
METRICS = {"coverage": ("covered", "source_rows"), "mismatch": ("differing", "source_rows"), "extra": ("extra", "target_rows")}


def wilson(p: Column, d: Column, z: float) -> tuple[Column, Column]:
    """Bounds of a share that was seen to be ``p``, where 1 / d independent rows would be
    as sure as the sample was."""
    middle, half = p + z * z * d / 2, z * F.sqrt(F.greatest(p * (1 - p) * d + (z * d) * (z * d) / 4, F.lit(0.0)))
    whole = 1 + z * z * d
    return F.greatest((middle - half) / whole, F.lit(0.0)), F.least((middle + half) / whole, F.lit(1.0))


def estimates(keys: DataFrame, rated: DataFrame, at: list[int], confidence: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """metric, estimate, lower, upper (shares of all rows), population, sampled_rows,
    strata, exact_strata from the totals of the sampled keys. ``by`` keeps several
    samples apart (tests draw a hundred at once)."""
    z, hs = NormalDist().inv_cdf(0.5 + confidence / 2), [f"h{i}" for i in range(len(at))]
    sums = []
    for name, (y, x) in METRICS.items():
        sums += [F.sum(y).alias(f"{name}_y"), F.sum(x).alias(f"{name}_x"), F.sum(F.col(x).cast("double") * F.col(x)).alias(f"{name}_xx")]
    found = keys.withColumns({h: F.col(f"k{k}") for k, h in zip(at, hs, strict=True)}).groupBy(*by, *hs).agg(*sums)
    samples = keys.select(*by).distinct() if by else None
    all_strata = rated.join(samples) if by else rated  # a row a stratum and sample
    same = every([all_strata[h].eqNullSafe(found[h]) for h in hs] + [all_strata[b] == found[b] for b in by])
    joined = all_strata.join(found, same, "left").select(*(all_strata[b] for b in by), "rate", "source_rows", "target_rows", *(F.coalesce(f"{m}_{v}", F.lit(0)).cast("double").alias(f"{m}_{v}") for m in METRICS for v in ("y", "x", "xx")))

    def of(name: str, total: str) -> Column:
        y, x, xx = (F.col(f"{name}_{v}") for v in ("y", "x", "xx"))
        p = F.when(x > 0, y / x).otherwise(0.5)
        d = F.when(x > 0, (1 - F.col("rate")) * xx / (x * x)).otherwise(1e9)  # nothing seen, nothing known
        low, high = wilson(p, d, z)
        return F.struct(F.lit(name).alias("metric"), F.col(total).cast("double").alias("rows"), x.alias("seen"), p.alias("p"), low.alias("low"), high.alias("high"), (F.col("rate") >= 1).alias("exact"))

    each = joined.select(*by, F.explode(F.array(*(of(m, x) for m, (_, x) in METRICS.items()))).alias("e")).select(*by, "e.*").filter("rows > 0")
    total = F.sum("rows")
    out = each.groupBy(*by, "metric").agg(
        (F.sum(F.col("rows") * F.col("p")) / total).alias("estimate"),
        (F.sqrt(F.sum(F.pow(F.col("rows") * (F.col("p") - F.col("low")), 2))) / total).alias("below"),
        (F.sqrt(F.sum(F.pow(F.col("rows") * (F.col("high") - F.col("p")), 2))) / total).alias("above"),
        total.cast("long").alias("population"),
        F.sum("seen").cast("long").alias("sampled_rows"),
        F.count(F.lit(1)).alias("strata"),
        F.count_if("exact").alias("exact_strata"),
    )
    bounds = {"lower": F.greatest(F.col("estimate") - F.col("below"), F.lit(0.0)), "upper": F.least(F.col("estimate") + F.col("above"), F.lit(1.0))}
    return out.withColumns(bounds).select(*by, "metric", "estimate", "lower", "upper", "population", "sampled_rows", "strata", "exact_strata")


def sampled_metrics(source: DataFrame, target: DataFrame, spec: ReconSpec, rows: int, strata: tuple[str, ...] = (), seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """A row for each of METRICS, over the rows with usable keys: share of source rows
    that are matched (coverage), that are matched and differ (mismatch), share of target
    rows without a partner (extra). About ``rows`` rows of each stratum are matched;
    the rest of the tables is read for its keys alone."""
    s, t, rated = sample_sides(source, target, spec, rows, strata, seed)
    keys = key_totals(reconcile_records(s, t, spec), spec, s.columns, t.columns)
    return estimates(keys, rated, strata_of(spec, strata), confidence)
