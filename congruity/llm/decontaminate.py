"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is taken in blocks of bounded size. One pass over the documents
finds the n-grams of a block's items; how many documents have each is counted
over the whole corpus. An item's seeds are its n-grams but those far more frequent
than its median one (chance meetings of common words); in every stretch the rarest
is a seed in any case, so edits cannot hit all seeds. Where a document has a seed,
the stretch around it is aligned with the item, word by word.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, staged

WORD = re.compile(r"\w+")
#: Words of a seed, n-grams of a stretch that gives one, words of a block of items.
SEED, STRETCH, BLOCK_WORDS = 4, 6, 200_000
#: Times the median (at least LEAST documents) from which an n-gram is common.
COMMON, LEAST = 4, 100
#: Pieces of text, characters of one, and words of listed ones that a worker remembers.
REMEMBERED, LONG, LISTED = 200_000, 64, 2_000_000
#: Points of a match, a mismatch and a gap; share of an item's points that is a hit.
MATCH, MISMATCH, GAP, SHARE = 2, -1, -1, 0.5
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` word numbers; 0 where a word has none (number 0)."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    m = len(ids) - n + 1
    out, known = np.full(m, n, np.uint64), np.ones(m, bool)
    with np.errstate(over="ignore"):
        for k in range(n):
            part = ids[k : k + m]
            known &= part > 0
            out = (out ^ part.astype(np.uint64)) * FACTOR
            out ^= out >> np.uint64(29)
    return np.where(known, out | np.uint64(1), np.uint64(0))


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: points, first and last word of ``words`` (from 0).

    Rows of the table go along the item; the gap along a row is a running maximum.
    """
    n = len(words)
    slope = -GAP * np.arange(1, n + 1)
    above, origin_above = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, -1)
    for w in item:
        diagonal = above[:-1] + np.where((words == w) & (w > 0), MATCH, MISMATCH)
        down = above[1:] + GAP
        row = np.maximum(np.maximum(diagonal, down), 0)
        origin = np.where(diagonal >= down, origin_above[:-1], origin_above[1:])
        origin = np.where(row > 0, origin, np.arange(1, n + 1))
        lifted = row + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n), 0))
        spread = top - slope
        better = spread > row
        row, origin = np.where(better, spread, row), np.where(better, origin[source], origin)
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(origin[k]), k)
        above, origin_above = np.concatenate(([0], row)), np.concatenate(([0], origin))
    return best


class Pieces(dict):
    """Codes of pieces without white space."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers, self.lists, self.listed = numbers, [], 0

    def __missing__(self, piece: str) -> int:
        words = WORD.findall(piece)
        if len(words) == 1:
            code = self.numbers.get(words[0], 0)
        else:
            self.lists.append(np.array([self.numbers.get(w, 0) for w in words], np.int64))
            self.listed += len(words)
            code = -len(self.lists)
        if len(piece) <= LONG:
            self[piece] = code
        return code

    def forget(self) -> None:
        self.clear()
        self.lists.clear()
        self.listed = 0


class Block:
    """Items of one block: word numbers, n-grams, and where they stand in items."""

    def __init__(self, items: list[tuple], n: int):
        self.names = [i for i, _ in items]
        found = [WORD.findall(t.lower()) for _, t in items]
        self.numbers = {w: k + 1 for k, w in enumerate(sorted({w for ws in found for w in ws}))}
        self.words = [np.array([self.numbers[w] for w in ws], np.int64) for ws in found]
        self.sizes = sorted({min(n, len(w)) for w in self.words})
        self.grams = [gram_hashes(w, min(n, len(w))) for w in self.words]
        self.known = np.unique(np.concatenate(self.grams))

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "seen"}

    def number(self, text: str) -> np.ndarray:
        """Numbers of a text's words. What stands between white space is mostly one
        word and is remembered: its number, or below 0 where its words are listed."""
        seen = vars(self).setdefault("seen", Pieces(self.numbers))
        if len(seen) >= REMEMBERED or seen.listed >= LISTED:  # between texts, as codes point into the lists
            seen.forget()
        code = np.fromiter(map(seen.__getitem__, text.lower().split()), np.int64)
        if not (code < 0).any():
            return code
        return np.concatenate([seen.lists[-c - 1] if c < 0 else (c,) for c in code.tolist()]).astype(np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of the items in a text, and where they start."""
        grams, at = [], []
        for n in self.sizes:
            g = gram_hashes(ids, n)
            k = np.flatnonzero(g)
            if len(k):
                k = k[self.known[np.minimum(np.searchsorted(self.known, g[k]), len(self.known) - 1)] == g[k]]
            grams.append(g[k])
            at.append(k)
        return np.concatenate(grams), np.concatenate(at)

    def seeds(self, frequency: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        """N-gram -> (item, offset). Copies of an item raise all its n-grams alike, so
        what is rare is measured against the item's own median."""
        out = defaultdict(list)
        for i, grams in enumerate(self.grams):
            df = [frequency.get(int(np.int64(np.uint64(g))), 0) for g in grams]
            bound = COMMON * max(float(np.median(df)), LEAST)
            chosen = {j for j, n in enumerate(df) if n <= bound}
            chosen |= {min(range(k, min(k + STRETCH, len(df))), key=lambda j: (df[j], j)) for k in range(max(1, len(df) - STRETCH + 1))}
            for j in sorted(chosen):
                out[int(grams[j])].append((i, j))
        return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, words: int) -> Iterator[list[tuple]]:
    """Items in order, at most ``words`` words at a time, or one longer item alone. They
    come partition by partition, so the driver holds one of those and one block."""
    rows = benchmark.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).filter(F.col("t").isNotNull()).distinct()
    held, total = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        n = len(WORD.findall(r["t"]))
        if held and total + n > words:
            yield held
            held, total = [], 0
        if n:
            held.append((r["i"], r["t"]))
            total += n
    if held:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs`` and item it holds: ``id_col``, ``item_col``, score,
    first_word, last_word, text_hash (xxhash64 of the text).

    score is the points of the best local alignment over those of the whole item,
    at least ``share``; the words are those of the document, from 0. Words are
    runs of letters, digits and underscores in lower case. Null and empty texts
    or items match nothing; repeated rows of ``docs`` give a row each, repeated
    items one; null ids are carried. Extra columns are ignored; empty tables give
    an empty result. Items of fewer words than a seed are their own seed.
    """
    spark = docs.sparkSession
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {id_kind}, `{item_col}` {item_kind}, score double, first_word int, last_word int, text_hash bigint"
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    out = spark.createDataFrame([], schema)
    for items in blocks(benchmark, item_col, item_text_col, block_words):
        block = Block(items, SEED)
        sent = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in in_slices(batches):
                keep, words, grams, at = [], [], [], []
                for k, text in enumerate(batch.column(1)):
                    ids = own.number(text.as_py() or "")
                    g, p = own.hits(ids)
                    if len(g):
                        keep.append(k)
                        words.append(ids.astype(np.int32))
                        grams.append(g.view(np.int64))
                        at.append(p.astype(np.int32))
                if keep:
                    some = batch.take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(words, pa.list_(pa.int32())), pa.array(grams, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))], [id_col, "text_hash", "words", "grams", "at"])

        hits = staged(rows.mapInArrow(find, f"`{id_col}` {id_kind}, text_hash bigint, words array<int>, grams array<bigint>, at array<int>"))
        # One count for each n-gram of the block: as many rows as the block has words.
        counts = hits.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").count()
        seeds = spark.sparkContext.broadcast(block.seeds({r["gram"]: r["count"] for r in counts.collect()}))

        def score(batches: Iterator[pa.RecordBatch], sent=sent, seeds=seeds) -> Iterator[pa.RecordBatch]:
            own, wanted = sent.value, seeds.value
            for batch in batches:
                found = []
                for k in range(batch.num_rows):
                    words = batch.column(2)[k].values.to_numpy().astype(np.int64)
                    starts = defaultdict(list)
                    for g, p in zip(batch.column(3)[k].values.to_numpy().view(np.uint64).tolist(), batch.column(4)[k].values.to_numpy().tolist(), strict=True):
                        for i, j in wanted.get(g, ()):
                            starts[i].append(p - j)
                    for i, places in starts.items():
                        item = own.words[i]
                        m = len(item)
                        pad, best, places = m // 2 + 4, (0, 0, -1), sorted(places)
                        first = last = places[0]
                        for p in [*places[1:], math.inf]:
                            if p - last > 2 * pad + m:  # stretches that cannot touch are aligned apart
                                a, b = max(0, first - pad), min(len(words), last + m + pad)
                                points, x, y = align(item, words[a:b])
                                if points > best[0]:
                                    best = (points, x + a, y + a)
                                first = p
                            last = p
                        if best[0] >= share * MATCH * m:
                            found.append((k, own.names[i], best[0] / (MATCH * m), best[1], best[2]))
                if found:
                    some = batch.take(pa.array([x[0] for x in found]))
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0), pa.array([x[1] for x in found]), pa.array([x[2] for x in found]), pa.array([x[3] for x in found], pa.int32()), pa.array([x[4] for x in found], pa.int32()), some.column(1)],
                        [id_col, item_col, "score", "first_word", "last_word", "text_hash"],
                    )

        out = out.unionByName(hits.mapInArrow(score, schema))
    return out
