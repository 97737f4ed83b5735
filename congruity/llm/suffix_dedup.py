"""Removal of repeated byte strings by a sampled suffix sort.

A difference cover samples positions so that any two suffixes meet the sample at
equal distance. For strings of ``length`` bytes it is enough that equal strings
do: the sample is the leftmost minimum of the hashed CORE-byte strings in every
string of that length, about one position in 170 instead of two in three.

Sampled positions are sorted and named by their core; positions with a name of
their own are done, the others are named again by all bytes of the strings that
contain the core. Equal names merge into one, and of the names that share a core
the suffixes at every distance before it are sorted and adjacent ones compared.
What is equal is covered, in every document that has the name.

Arithmetic hashes choose the sample and the groups; they decide nothing. Names of
surroundings are BLAKE2 digests of 64 bits under a key drawn for each run, and
adjacent strings of a group are compared byte by byte (in a group too large for one
task, by digests of 96 bits). Before a document loses what a name says, a second digest of 128 bits under another key must agree, or the run
stops.
"""

from __future__ import annotations

import secrets
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

LENGTH, CORE = 400, 64
#: Bytes of a text hashed at once; names of one core that one task sorts.
SEGMENT, GROUP = 1 << 19, 20_000
#: Cells of a sort table held at once; surroundings of whole cores sorted at once, about.
CELLS, BLOCK = 2_000_000, 250
LOW = np.uint64((1 << 20) - 1)


@lru_cache(1)
def tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, powers of an odd base, powers of its inverse."""
    rng = np.random.default_rng(11)
    base = int(rng.integers(1, 2**62)) * 2 + 1
    with np.errstate(over="ignore"):
        powers, inverse = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64)))) for b in (np.uint64(base), np.uint64(pow(base, -1, 2**64))))
    return rng.integers(1, 2**63, 256, np.uint64), powers, inverse


class Hashes:
    """Hashes of substrings of one piece of text."""

    def __init__(self, data: np.ndarray):
        values, self.powers, inverse = tables(SEGMENT + 4 * LENGTH)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[data] * inverse[: len(data)])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.powers[end]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(32))


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    z = np.concatenate((x, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    before = np.minimum.accumulate(z, axis=1).ravel()
    after = np.minimum.accumulate(z[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def digest(data: bytes, key: bytes, left: int = 0, size: int = 16) -> bytes:
    return blake2b(data, digest_size=size, key=key, person=left.to_bytes(4, "little")).digest()


def sample(data: bytes, length: int, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions, each once, and the hashes of their cores."""
    found: list[list[np.ndarray]] = [[], []]
    text, n, w, latest = np.frombuffer(data, np.uint8), len(data), length - CORE + 1, -1
    for begin in range(0, n - length + 1, segment):
        end = min(begin + segment, n - length + 1)  # of the starts of this segment
        first, last = begin, min(n, end + length)
        hashes = Hashes(text[first:last])
        at = np.arange(begin - first, end - 1 + w - first)
        core = hashes.of(at, at + CORE)
        least = sliding_minimum((core & ~LOW) | np.arange(len(core)).astype(np.uint64), w)
        chosen = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        k = (least[chosen] & LOW).astype(np.int64)
        k = k[at[k] + first > latest]  # positions ascend; the last segment may have chosen the first
        pos = at[k] + first
        latest = int(pos[-1]) if len(pos) else latest
        for kept, new in zip(found, (pos, core[k]), strict=True):
            kept.append(new)
    kinds = (np.int64, np.uint64)  # empty lists too: mixed kinds would become floats
    return tuple(np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(found, kinds, strict=True))


def surroundings(data: bytes, positions: np.ndarray, length: int, key: bytes) -> np.ndarray:
    """Names of all bytes of the strings of ``length`` bytes that contain the core, and
    of where the core stands among them."""
    most, view = length - CORE, memoryview(data)
    return np.frombuffer(b"".join([digest(view[max(0, p - most) : p + length], key, min(p, most), 8) for p in positions.tolist()]), np.int64)


def intervals(covered: np.ndarray, length: int) -> list[int]:
    """Bytes relative to the core that strings at the covered distances take up, as
    from, to, from, to; ``covered`` is indexed by the distance before the core."""
    return intervals_of(covered[None, :], length).to_pylist()[0]


def intervals_of(covered: np.ndarray, length: int) -> pa.ListArray:
    """The same for each row of ``covered``."""
    border = np.zeros((len(covered), 1), np.int8)
    row, edge = np.nonzero(np.diff(np.concatenate((border, covered.astype(np.int8), border), axis=1), axis=1))
    row, a, b = row[::2], edge[::2], edge[1::2]
    order = np.lexsort((-a, row))
    found = np.stack((1 - b, length - a), axis=1)[order].ravel()
    ends = 2 * np.cumsum(np.bincount(row, minlength=len(covered)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(found, pa.int32()))


def side_by_side(lefts: np.ndarray, blobs: list[bytes], length: int) -> np.ndarray:
    """A row of bytes for each surrounding, with the cores in one column."""
    w = length - CORE + 1
    out = np.zeros((len(blobs), w - 1 + length), np.uint8)
    for r, (left, blob) in enumerate(zip(lefts.tolist(), blobs, strict=True)):
        at = w - 1 - left
        out[r, at : at + len(blob)] = np.frombuffer(blob, np.uint8)
    return out


def whole_strings(lefts: np.ndarray, blobs: list[bytes], length: int) -> np.ndarray:
    """Row for each surrounding, column for each distance: whether a string starts there."""
    sizes, distance = np.array([len(b) for b in blobs], np.int64), np.arange(length - CORE + 1)[None, :]
    return (distance <= lefts[:, None]) & (lefts[:, None] - distance + length <= sizes[:, None])


def window_names(lefts: np.ndarray, blobs: list[bytes], length: int) -> np.ndarray:
    """Row for each surrounding, column for each distance: the hash of the string
    that starts so far before the core (only names of one column compare); unequal
    fillers where there is none."""
    w = length - CORE + 1
    out = np.arange(len(blobs) * w, dtype=np.uint64).reshape(len(blobs), w)
    values, _, inverse = tables(SEGMENT + 4 * LENGTH)
    for k in range(0, len(blobs), BLOCK):
        data = side_by_side(lefts[k : k + BLOCK], blobs[k : k + BLOCK], length)
        sums = np.zeros((len(data), data.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values[data] * inverse[None, : data.shape[1]], axis=1, out=sums[:, 1:])
            found = (sums[:, length:] - sums[:, :-length])[:, ::-1]
        np.copyto(out[k : k + BLOCK], found, where=whole_strings(lefts[k : k + BLOCK], blobs[k : k + BLOCK], length))
    return out


class Aligned:
    """Surroundings laid side by side with their cores in one column."""

    def __init__(self, lefts: np.ndarray, blobs: list[bytes], length: int):
        self.length, self.w, self.bytes = length, length - CORE + 1, side_by_side(lefts, blobs, length)

    def agree(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes in which rows ``a`` and ``b`` agree before the core, and from it on."""
        before, after = np.empty(len(a), np.int32), np.empty(len(a), np.int32)
        for k in range(0, len(a), 4096):
            x, y = self.bytes[a[k : k + 4096]], self.bytes[b[k : k + 4096]]
            unlike = np.ones((len(x), x.shape[1] + 2), bool)  # a border on either side
            np.not_equal(x, y, out=unlike[:, 1:-1])
            before[k : k + 4096] = unlike[:, self.w - 1 :: -1].argmax(axis=1)
            after[k : k + 4096] = unlike[:, self.w :].argmax(axis=1)
        return before, after

    def repeated(self, rows: np.ndarray, distance: int) -> np.ndarray:
        """Which of ``rows`` have a string at ``distance`` that another of them has."""
        at = self.w - 1 - distance
        by = defaultdict(list)
        for r in rows.tolist():
            by[self.bytes[r, at : at + self.length].tobytes()].append(r)
        return np.array([r for same in by.values() if len(same) > 1 for r in same], np.int64)


def whole_cores(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.Table]:
    """Tables of ``rows`` rows or more that split no core; the rows come sorted by core."""
    rest: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        rest = part if rest is None else pa.concat_tables([rest, part])
        core = rest["core"].to_numpy()
        begins, at = np.flatnonzero(core[1:] != core[:-1]) + 1, 0
        while (k := int(np.searchsorted(begins, at + rows))) < len(begins):
            yield rest.slice(at, int(begins[k]) - at)
            at = int(begins[k])
        rest = rest.slice(at)
    if rest is not None and rest.num_rows:
        yield rest


def solve(group: pa.Table, length: int, key: bytes = b"") -> pa.Table:
    """For the surroundings of whole cores: which bytes around each are covered. Strings
    are sorted by their hashes; adjacent ones of one hash are compared by their bytes.
    Equal strings have one core at one distance, so several cores are sorted as one."""
    lefts, blobs, many = group["left"].to_numpy(), group["bytes"].to_pylist(), group["n"].to_numpy() > 1
    m, exists = len(blobs), whole_strings(lefts, blobs, length)
    covered = np.zeros(exists.shape, bool)
    if m > 1:
        aligned, names = Aligned(lefts, blobs, length), window_names(lefts, blobs, length)
        step = max(1, CELLS // m)
        for k in range(0, names.shape[1], step):
            part = np.ascontiguousarray(names[:, k : k + step].T)
            order = np.argsort(part, axis=1, kind="stable")
            in_order = np.take_along_axis(part, order, axis=1)
            column, near = np.nonzero(in_order[:, 1:] == in_order[:, :-1])
            a, b, distance = order[column, near], order[column, near + 1], column + k
            real = exists[a, distance] & exists[b, distance]
            a, b, distance = a[real], b[real], distance[real]
            pairs, which = np.unique(a * m + b, return_inverse=True)
            before, after = (x[which] for x in aligned.agree(pairs // m, pairs % m))
            same = (before >= distance) & (after >= length - distance)
            covered[a[same], distance[same]] = covered[b[same], distance[same]] = True
            for d in np.unique(distance[~same]).tolist():  # one hash, unequal bytes
                rows = np.unique(np.concatenate((a[distance == d], b[distance == d])))
                covered[rows, d] = False
                covered[aligned.repeated(rows, d), d] = True
    covered = (covered | many[:, None]) & exists
    checks = [digest(b, key, n) if some else b"" for b, n, some in zip(blobs, lefts.tolist(), covered.any(axis=1).tolist(), strict=True)]
    return pa.table({"core": group["core"], "around": group["around"], "check": pa.array(checks, pa.binary()), "spans": intervals_of(covered, length)})


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (array of struct start,
    end: the maximal runs that go, in bytes), kept (binary: what stays).

    A byte goes if a string of ``length`` UTF-8 bytes (at least twice CORE) that
    covers it also starts anywhere else, in the same text or another, overlaps
    included; strings never cross texts and are judged on the input, by their bytes
    or keyed digests of them, whatever the hashes of the sample say. Null texts
    are empty; repeated rows are texts of their own; null ids are carried. Extra
    columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    data = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(data).alias("hash")).alias("doc"), data.alias("data"))
    doc_kind = f"struct<id:{kind},hash:bigint>"
    key, second = secrets.token_bytes(16), secrets.token_bytes(16)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            found = [sample(t, length) for t in texts]
            owner = np.repeat(np.arange(batch.num_rows), [len(p) for p, _ in found])
            pos, core = (np.concatenate([f[k] for f in found]) for k in range(2))
            around = np.concatenate([surroundings(t, p, length, key) for t, (p, _) in zip(texts, found, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(pos), pa.array(core.view(np.int64)), pa.array(around)], ["doc", "pos", "core", "around"])

    sampled = staged(rows.mapInArrow(find, f"doc {doc_kind}, pos bigint, core bigint, around bigint"))
    # Counts are written before they are joined: Spark splits a hot core's partition only
    # in a join that stands alone.
    cores = staged(sampled.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("core"))
    shared = staged(sampled.join(cores, "core", "left_semi"))
    names = staged(shared.groupBy("core", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos")).alias("at")))
    per_core = staged(names.groupBy("core").agg(F.count(F.lit(1)).alias("names")))
    wanted = staged(names.join(per_core, "core").select("core", "around", "n", "names", F.col("at.doc").alias("doc"), F.col("at.pos").alias("pos")))

    w = length - CORE + 1
    left = F.least(F.col("pos"), F.lit(w - 1)).cast("int")
    # Rows that repeat a document repeat its surroundings, whose n is over 1 anyway. The
    # texts are dealt out by document once, here and for the removal below.
    cut = rows.join(wanted, "doc").select("core", "around", "n", "names", left.alias("left"), F.expr(f"substring(data, CAST(pos - least(pos, {w - 1}) + 1 AS INT), CAST(least(pos, {w - 1}) + {length} AS INT))").alias("bytes"))
    spans_schema = "core bigint, around bigint, check binary, spans array<int>"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in whole_cores(batches):
            yield from solve(some, length, second).combine_chunks().to_batches()

    solved = cut.filter(F.col("names") <= GROUP).repartition("core").sortWithinPartitions("core").mapInArrow(settle, spans_schema)

    # Cores with more names than a task sorts: a row for each string, counted by name.
    large = cut.filter(F.col("names") > GROUP)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                row, distance, name = [], [], []
                for r, (left, blob) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                    for d in range(max(0, left + length - len(blob)), left + 1):
                        row.append(r)
                        distance.append(d)
                        name.append(digest(blob[left - d : left - d + length], key, size=12))
                some = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(distance, pa.int32()), pa.array(name, pa.binary())], ["core", "around", "n", "distance", "name"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for distances in batch.column(2):
                covered = np.zeros(w, bool)
                covered[distances.values.to_numpy()] = True
                spans.append(intervals(covered, length))
            checks = [digest(b, second, n) for n, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(checks, pa.binary()), pa.array(spans, pa.list_(pa.int32()))], ["core", "around", "check", "spans"])

    if not per_core.filter(F.col("names") > GROUP).isEmpty():
        strings = large.select("core", "around", "n", "left", "bytes").mapInArrow(spread, "core bigint, around bigint, n bigint, distance int, name binary")
        again = strings.groupBy("core", "distance", "name").agg(F.sum("n").alias("c")).filter("c > 1").drop("c")
        hits = strings.join(again, ["core", "distance", "name"], "left_semi").groupBy("core", "around").agg(F.collect_list("distance").alias("distances"))
        hits = hits.join(large.select("core", "around", "left", "bytes"), ["core", "around"])
        solved = solved.unionByName(hits.mapInArrow(gather, spans_schema))

    found = shared.join(solved.filter(F.size("spans") > 0), ["core", "around"]).groupBy("doc").agg(F.collect_list(F.struct("pos", "check", "spans")).alias("found"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for data, found in zip(batch.column(1), batch.column(2), strict=True):
                text, found = data.as_py(), found.as_py() or []
                for f in found:
                    left = min(f["pos"], length - CORE)
                    if digest(text[f["pos"] - left : f["pos"] + length], second, left) != f["check"]:
                        raise RuntimeError("two surroundings have one name: run again, under another key")
                gone = merged([(f["pos"] + a, f["pos"] + b) for f in found for a, b in zip(f["spans"][::2], f["spans"][1::2], strict=True)])
                stays, at = [], 0
                for a, b in gone:
                    stays.append(text[at:a])
                    at = b
                stays.append(text[at:])
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b"".join(stays))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    out = rows.join(found, "doc", "left").select(F.col("doc.id").alias("doc_id"), "data", "found")
    return out.mapInArrow(remove, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")

