"""Removal of repeated word sequences by locally consistent names.

Recompression renames a text in rounds, runs first, then pairs, so that equal substrings
get equal symbols except near their ends. Names here are keyed hashes of what they stand
for: every task gives the same run or pair the same name, where a dictionary would have
to shuffle all words in every round. Four rounds are needed:

- the whole text gets a name; copies of a text go by it at once;
- runs: more than 25 equal words stand for no more windows than 25 do;
- pairs: half of all names are left ones; a left name and a right one behind it make a
  pair. Names of four symbols in a row that lie inside a window depend on nothing
  outside, and every window has some: the least of them is the window's symbol, and
  neighbouring windows mostly share theirs;
- windows whose symbol two ids have are named themselves, by 96 bits, and what has the
  name of an earlier id is covered.

A symbol or name takes one shuffle. What several ids share within a task is settled
there: one or two of them are passed on as witnesses, however many there are.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import failing, filter_of, in_slices, passing, staged
from .word_names import M1, mixed, sequence_names, word_names

WINDOW = 13
#: Symbols whose names a window compares; the shortest window that always has some.
BLOCK, SHORTEST = 4, 12
#: Words of the texts that are named together.
HELD = 1 << 20


def pair_symbols(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and name of each symbol: a pair, or one word."""
    left = (names >> np.uint64(7)) & np.uint64(1) == 1
    merge = left[:-1] & ~left[1:] & (text[1:] == text[:-1])
    start = np.flatnonzero(np.concatenate(([True], ~merge)))
    out, pair = names[start], np.concatenate((merge, [False]))[start]
    out[pair] = mixed(out[pair] * M1 + names[start[pair] + 1])
    return start, out


def window_symbols(names: np.ndarray, text: np.ndarray, window: int, key: int) -> np.ndarray:
    """For each window the least name of BLOCK symbols between its first and its last
    word. Whether a symbol begins at a word depends on this word and the one before."""
    start, symbols = pair_symbols(names, text)
    blocks = sequence_names(symbols, BLOCK, key, turn=1)
    upto = np.cumsum(np.bincount(start, minlength=len(names)))  # symbols that begin up to a word
    first = upto[: len(names) - window + 1]
    last = upto[window - 1 :] - 2 - BLOCK + 1  # the symbol of the last word ends outside
    least = blocks[np.minimum(first, len(blocks) - 1)]
    for k in range(1, window - 1 - BLOCK):
        np.minimum(least, blocks[np.minimum(first + k, np.maximum(last, first))], out=least)
    return least


class Windows:
    """The windows of some texts; ``kept`` are the words left of the runs."""

    def __init__(self, texts: list[bytes], window: int, key: int):
        words = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        names, _, _ = word_names(b" ".join([b"", *(b" ".join(w) for w in words if w), b""]), key)
        text = np.repeat(np.arange(len(texts)), self.sizes)
        begin = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (text[1:] != text[:-1])))[: len(names)])
        size = np.diff(begin, append=len(names))
        at, self.run = np.arange(len(names)), np.repeat(begin, size)
        self.kept = np.flatnonzero((at - self.run < window) | (np.repeat(begin + size, size) - at < window))
        self.window, self.key, self.names, self.text = window, key, names[self.kept], text[self.kept]
        n = max(len(self.names) - window + 1, 0)
        self.inside = self.text[:n] == self.text[window - 1 :] if n else np.zeros(0, bool)

    def symbols(self) -> np.ndarray:
        return window_symbols(self.names, self.text, self.window, self.key)[self.inside] if self.inside.any() else np.zeros(0, np.uint64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of the windows inside a text: of 64 bits, and of 32 more."""
        one, two = (sequence_names(self.names, self.window, self.key, turn)[self.inside] for turn in (2, 3))
        return one, (two >> np.uint64(32)).astype(np.uint32)

    def owner(self) -> np.ndarray:
        return self.text[: len(self.inside)][self.inside]

    def covered(self, gone: np.ndarray) -> np.ndarray:
        """Words of the texts in a window of which ``gone`` says so."""
        first = np.flatnonzero(self.inside)[gone]
        edge = np.bincount(first, minlength=len(self.names) + 1) - np.bincount(first + self.window, minlength=len(self.names) + 1)
        out = np.zeros(int(self.sizes.sum()), bool)
        out[self.kept] = np.cumsum(edge)[: len(self.names)] > 0
        left_out = np.ones(len(out), bool)
        left_out[self.kept] = False
        out[left_out] = out[self.run[left_out] + self.window - 1]  # as the middle of the run
        return out


def in_portions(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Slices with some HELD words (of five bytes) in column ``at``, one row at least."""
    for part in in_slices(batches):
        size = np.cumsum(pc.binary_length(part.column(at)).fill_null(0).to_numpy())
        first = 0
        while first < part.num_rows:
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + 5 * HELD, "right")))
            yield part.slice(first, last - first)
            first = last


def ranked(ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct ids in order, and the place of each id among them."""
    codes = ids.dictionary_encode()
    order = pc.sort_indices(codes.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return codes.dictionary.take(pa.array(order)), place[codes.indices.to_numpy()]


def run_edges(name: np.ndarray, check: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (name, check, rank) in order, and for each the places where the rows of
    its name and check begin and end."""
    order = np.lexsort((rank, check, name))
    name, check, rank = name[order], check[order], rank[order]
    border = np.concatenate(([True], (name[1:] != name[:-1]) | (check[1:] != check[:-1])))[: len(name)]
    new = border | np.concatenate(([True], rank[1:] != rank[:-1]))[: len(name)]
    name, check, rank, border = name[new], check[new], rank[new], border[new]
    run = np.cumsum(border) - 1
    begin = np.flatnonzero(border)
    end = np.concatenate((begin[1:], [len(name)])).astype(np.int64)
    return name, check, rank, begin[run] if len(run) else run, end[run] - 1 if len(run) else run


def settled(ids: pa.Array, rows: np.ndarray, name: np.ndarray, check: np.ndarray, later: bool) -> pa.RecordBatch:
    """Rows settled, name, check, id of a task. ``later``: a name counts where an earlier
    id has it; else where any other id has it. What the task can tell is settled; the
    first id (and the last) of a name is passed on for other tasks to see."""
    values, rank = ranked(ids)
    name, check, rank, begin, end = run_edges(name, check, rank[rows])
    at = np.arange(len(name))
    counts = begin < at if later else begin < end
    witness = at == begin if later else (at == begin) | (at == end)
    rows = np.concatenate((at[counts], at[witness & ~counts] if later else at[witness]))
    done = np.arange(len(rows)) < counts.sum()
    return pa.RecordBatch.from_arrays([pa.array(done), pa.array(name[rows].view(np.int64)), pa.array(check[rows].view(np.int32)), values.take(pa.array(rank[rows]))], ["settled", "name", "check", "id"])


def follow(later: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by settled, name, check, id: id, name of those that count. One
    row is carried from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # the last row, the first id of its name, whether it counts so far
        for batch in batches:
            if not batch.num_rows:
                continue
            if carried is not None:
                batch = pa.concat_batches([carried[0], batch])
            done, name, check, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            n = batch.num_rows
            same = np.concatenate(([False], (name[1:] == name[:-1]) & (check[1:] == check[:-1]) & (done[1:] == done[:-1])))
            first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
            firsts = ids.take(pa.array(first))
            if carried is not None:  # its rows go back to before this batch
                firsts = pc.if_else(pa.array(first == 0), carried[1], firsts)
            unlike = pc.not_equal(ids, firsts).to_numpy(zero_copy_only=False)
            counts = done | unlike
            if not later:  # the first id counts once another one follows
                other = np.zeros(n, bool)
                other[first[unlike]] = True
                counts |= other[first]
            if carried is not None:
                counts[0] |= carried[2]
            last = n - 1
            carried = batch.slice(last), firsts[last], bool(counts[last])
            rows = pa.array(np.flatnonzero(counts[:last]))
            yield pa.RecordBatch.from_arrays([ids.take(rows), batch.column(1).take(rows)], ["id", "name"])
        if carried is not None and carried[2]:
            yield pa.RecordBatch.from_arrays([carried[0].column(3), carried[0].column(1)], ["id", "name"])

    return run


def shared(rows: DataFrame, later: bool, kind: str) -> DataFrame:
    """id, names: what counts, by id. Settled rows are dealt out by id, so that no name
    is in more rows of a task than there were tasks before, twice."""
    to = F.when(F.col("settled"), F.xxhash64("id")).otherwise(F.xxhash64("name"))
    found = rows.repartition(to).sortWithinPartitions("settled", "name", "check", "id").mapInArrow(follow(later), f"id {kind}, name bigint")
    return found.groupBy("id").agg(F.collect_list("name").alias("names"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (binary: the words
    that stay, joined by a blank).

    Words are what ASCII white space parts. A word goes if ``window`` words in a row that
    cover it (SHORTEST or more) also stand in a row with a smaller id; windows are judged
    on the input and never cross texts. Null texts have no words. Rows of one id remove
    nothing from each other; null ids remove nothing and lose nothing. Repeats inside a
    text stay. Extra columns are ignored; an empty table gives an empty result.
    """
    if window < SHORTEST:
        raise ValueError(f"windows of fewer than {SHORTEST} words may lack a symbol")
    kind, key = docs.schema[id_col].dataType.simpleString(), secrets.randbits(62)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("data"))
    known = rows.filter("id IS NOT NULL")
    schema = f"settled boolean, name bigint, check int, id {kind}"

    # Whole texts: ids whose text an earlier id has.
    whole = staged(known.select("id", F.unhex(F.sha2("data", 256)).alias("text")).distinct())
    first = staged(whole.groupBy("text").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    copies = staged(whole.join(first, "text").filter("id > first").groupBy("id").agg(F.collect_set("text").alias("copies")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_portions(batches, 1):
            own = Windows([x.as_py() for x in part.column(1)], window, key)
            symbols, owner = own.symbols(), own.owner()
            new = np.concatenate(([True], (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])))[: len(symbols)]
            yield settled(part.column(0), owner[new], symbols[new], np.zeros(int(new.sum()), np.uint32), False)

    symbols = shared(known.mapInArrow(find, schema), False, kind)
    wanted = staged(symbols.join(copies, "id", "left"))

    def outside_and_inside(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows without an id in ``found``, for the most part, and the others; only these
        are shuffled."""
        bits = staged(filter_of(found.select(F.xxhash64("id").alias("hash"))))
        named = rows.withColumn("hash", F.xxhash64("id"))
        return failing(named, bits).drop("hash"), passing(named, bits).drop("hash")

    def name_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_portions(batches, 1):
            texts, use, of, wanted = [], [], [], []
            for k, (text, names, copies) in enumerate(zip(part.column(1), part.column(2), part.column(3), strict=True)):
                text = text.as_py()
                if copies.is_valid and sha256(text).digest() in copies.as_py():
                    continue
                use.append(k)
                texts.append(text)
                wanted.append(names.values.to_numpy().view(np.uint64))
                of.append(np.full(len(wanted[-1]), len(texts) - 1))
            own = Windows(texts, window, key)
            owner = own.owner()
            hit = held(own.symbols(), owner, wanted, of)
            one, two = own.windows()
            yield settled(part.column(0).take(pa.array(use, pa.int64())), owner[hit], one[hit], two[hit], True)

    _, inside = outside_and_inside(wanted)
    windows = inside.join(wanted, "id").select("id", "data", "names", "copies").mapInArrow(name_windows, schema)
    gone = staged(shared(windows, True, kind).join(copies, "id", "full").select("id", "names", "copies"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_portions(batches, 1):
            sizes, removed, kept, use, texts, of, wanted = [], [], [], [], [], [], []
            for k, (text, names, copies) in enumerate(zip(part.column(1), part.column(2), part.column(3), strict=True)):
                text = text.as_py()
                words = text.split()
                copy = copies.is_valid and len(words) >= window and sha256(text).digest() in copies.as_py()
                sizes.append(len(words))
                removed.append(len(words) if copy else 0)
                kept.append(b"" if copy else b" ".join(words))
                if names.is_valid and not copy:
                    use.append(k)
                    texts.append(text)
                    wanted.append(names.values.to_numpy().view(np.uint64))
                    of.append(np.full(len(wanted[-1]), len(texts) - 1))
            own = Windows(texts, window, key)
            gone = own.covered(held(own.windows()[0], own.owner(), wanted, of))
            for k, last in zip(use, np.cumsum(own.sizes).tolist(), strict=True):
                mine = gone[last - sizes[k] : last]
                if mine.any():
                    words = kept[k].split(b" ")
                    removed[k] = int(mine.sum())
                    kept[k] = b" ".join([words[i] for i in np.flatnonzero(~mine).tolist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    outside, inside = outside_and_inside(gone)
    nothing = outside.select("id", "data", F.lit(None).cast("array<bigint>").alias("names"), F.lit(None).cast("array<binary>").alias("copies"))
    both = inside.join(gone, "id", "left").select("id", "data", "names", "copies").unionByName(nothing)
    return both.mapInArrow(remove, f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary")


def held(names: np.ndarray, owner: np.ndarray, wanted: list[np.ndarray], of: list[np.ndarray]) -> np.ndarray:
    """Which names are among those that are wanted of their text."""
    if not len(names):
        return np.zeros(0, bool)
    salt = lambda x: mixed(x.astype(np.uint64))
    own, other = names ^ salt(owner), np.concatenate([np.zeros(0, np.uint64), *wanted]) ^ salt(np.concatenate([np.zeros(0, np.int64), *of]))
    return np.isin(own, other)
