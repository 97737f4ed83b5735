"""Similarity self-join on word shingles: MinHash LSH forest, then exact counts.

Each tree labels a set of shingles with a sequence of minima; the labels of a tree are
the leaves of a prefix trie. Sets that share a node are candidates. Matching starts
at the full depth, where nodes hold near copies only; the prefixes are shortened by
one minimum at a time, until the links found so far let expect that the target
recall is reached, or the depth at which it is reached for every link. A pair is
compared once: at the longest prefix it shares, in the first tree where it does.
Large nodes are compared in pairs of blocks of bounded size. Links are counted
exactly on whole sets of shingles, and classes are closed over verified links only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_of, in_slices, passing, staged
from .components import components

WORDS, THRESHOLD, TARGET = 5, 0.8, 0.9999
TREES, DEPTH = 20, 5
#: Sets and shingles of one block; a task holds two blocks.
BLOCK_SETS, BLOCK_SHINGLES = 500, 2_000_000
#: Steps of the histogram of similarities, rows of a batch.
STEPS, ROWS = 20, 4096
MIX = np.uint64(0xFF51AFD7ED558CCD)


def recall(similarity: float | np.ndarray, trees: int, depth: int) -> float | np.ndarray:
    return 1 - (1 - similarity**depth) ** trees


def expected_recall(histogram: np.ndarray, threshold: float, trees: int, depth: int) -> float:
    """Share of all links found with prefixes of ``depth``, judged by those found: a
    link of similarity s stands for 1 / recall(s). ``histogram`` counts them by
    similarity, from ``threshold`` to 1 in equal steps; a step counts as its lower end."""
    if not histogram.sum():
        return recall(threshold, trees, depth)
    at = threshold + (1 - threshold) * np.arange(len(histogram)) / len(histogram)
    return float(histogram.sum() / (histogram / recall(at, trees, depth)).sum())


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of runs of ``n`` words (a shorter text: of all its words)."""
    words = np.array([xxhash.xxh3_64_intdigest(w) for w in text.lower().split()], np.uint64)
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ words[k : k + len(out)]) * MIX
            out ^= out >> np.uint64(32)
    return np.unique(out)


@lru_cache(1)
def multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> bytes:
    """The labels of all trees: ``depth`` minima of each, as big-endian 32-bit numbers."""
    a = multipliers(trees * depth)
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(found), 4096):  # long texts in parts: bounded memory
            np.minimum(least, (found[None, k : k + 4096] * a[:, None]).min(axis=1), out=least)
        return ((least * MIX) >> np.uint64(32)).astype(">u4").tobytes()


def read_signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").astype(np.uint32).reshape(len(column), TREES, DEPTH)


def prefix_numbers(sig: np.ndarray, depth: int) -> np.ndarray:
    """A number for each prefix of ``depth`` by set and tree, equal for equal ones."""
    out = np.zeros(sig.shape[:2], np.uint64)
    for t in range(sig.shape[1]):
        for k in range(depth):
            out[:, t] = np.unique(out[:, t] << np.uint64(32) | sig[:, t, k], return_inverse=True)[1]
    return out


def first_met(a: np.ndarray, b: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """Which pairs of signatures share a prefix of ``depth`` in ``tree``, in no tree
    before it, and none that is longer in any tree."""
    if len(a) * len(b) <= 1024:  # few pairs: all their prefixes at once
        same = np.logical_and.accumulate(a[:, None] == b[None], axis=3)
        meets = same[..., depth - 1]
        out = meets[..., tree] & ~meets[..., :tree].any(axis=2)
        return out & ~same[..., depth].any(axis=2) if depth < DEPTH else out
    both, n = np.concatenate((a, b)), len(a)
    at = prefix_numbers(both, depth)
    out = at[:n, None, tree] == at[None, n:, tree]
    for t in range(tree):
        out &= at[:n, None, t] != at[None, n:, t]
    if depth < DEPTH:
        longer = prefix_numbers(both, depth + 1)
        for t in range(TREES):
            out &= longer[:n, None, t] != longer[None, n:, t]
    return out


def in_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows that agree in ``keys``, a table each, of batches sorted by them."""
    held, known = [], None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        edge = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            key = tuple(c[a] for c in columns) if a < b else known
            if held and key != known:
                yield pa.Table.from_batches(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
            known = key
    if held:
        yield pa.Table.from_batches(held)


def in_batches(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Many small tables as few batches."""
    held, n = [], 0
    for t in tables:
        held.append(t)
        n += t.num_rows
        if n >= ROWS:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def fingerprint(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``rows`` with sets ``columns``.

    Shingles that most sets have are counted by the few sets that miss them, the
    others by the sets that have them; so near copies cost little more than their
    differences.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(code, kind="stable")
    owner, ends = owner[order], np.cumsum(count)
    row_of, column_of = np.full(m, -1), np.full(m, -1)
    row_of[rows], column_of[columns] = np.arange(len(rows)), np.arange(len(columns))
    out = np.zeros((len(rows), len(columns)), np.int32)

    frequent = np.flatnonzero(count > m // 2)
    missing = np.full(m, len(frequent))
    for s in frequent:
        have = owner[ends[s] - count[s] : ends[s]]
        missing[have] -= 1
        if count[s] < m:
            lack = np.ones(m, bool)
            lack[have] = False
            lack = np.flatnonzero(lack)
            r, c = row_of[lack], column_of[lack]
            out[np.ix_(r[r >= 0], c[c >= 0])] += 1
    out += (len(frequent) - missing[rows])[:, None].astype(np.int32) - missing[columns][None, :].astype(np.int32)

    rare = np.flatnonzero((count > 1) & (count <= m // 2))
    for n in np.unique(count[rare]):
        some = rare[count[rare] == n]
        if n <= 8:  # all pairs of places in short lists at once
            lists = owner[(ends[some] - n)[:, None] + np.arange(n)]
            for x in range(n):
                for y in range(n):
                    r, c = row_of[lists[:, x]], column_of[lists[:, y]]
                    ok = (r >= 0) & (c >= 0) & (x != y)
                    np.add.at(out, (r[ok], c[ok]), 1)
        else:
            for s in some:
                have = owner[ends[s] - n : ends[s]]
                r, c = row_of[have], column_of[have]
                out[np.ix_(r[r >= 0], c[c >= 0])] += 1
    return out


def sides(group: pa.Table) -> tuple[bool, np.ndarray, np.ndarray]:
    """Whether a group is one block, and its rows on either side."""
    x, y, block = (group[c].to_numpy() for c in ("x", "y", "block"))
    if x[0] == y[0]:
        return True, np.arange(len(block)), np.arange(len(block))
    return False, np.flatnonzero(block == x[0]), np.flatnonzero(block == y[0])


def needed(group: pa.Table, depth: int) -> pa.Table:
    """The rows of a group that meet another for the first time."""
    same, rows, columns = sides(group)
    if not len(rows) or not len(columns):
        return group.slice(0, 0).select(["fp", *GROUP, "block"])
    sig = read_signatures(group["sig"])
    new = first_met(sig[rows], sig[columns], group["tree"][0].as_py(), depth)
    if same:
        np.fill_diagonal(new, False)
    keep = np.zeros(group.num_rows, bool)
    keep[rows] |= new.any(axis=1)
    keep[columns] |= new.any(axis=0)
    return group.filter(pa.array(keep)).select(["fp", *GROUP, "block"])


def compare(group: pa.Table, depth: int, threshold: float) -> pa.Table:
    """Of each set of a group: its links (weighed by copies) to sets that it meets here
    for the first time, the least set they lead to, and their similarities."""
    keys, weight = group["fp"].to_pylist(), group["weight"].to_numpy()
    sets = [s.values.to_numpy() for s in group["shingles"].combine_chunks()]
    same, rows, columns = sides(group)
    sig, sizes = read_signatures(group["sig"]), np.array([len(s) for s in sets])
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
    rank = np.empty(len(keys), int)
    rank[order] = np.arange(len(keys))
    links, root, histogram = np.zeros(len(keys), np.int64), rank.copy(), np.zeros((len(keys), STEPS), np.int64)
    if len(rows) and len(columns):
        shared = overlaps(sets, rows, columns)
        union = sizes[rows][:, None] + sizes[columns][None, :] - shared
        hit = (shared >= threshold * union - 1e-9) & first_met(sig[rows], sig[columns], group["tree"][0].as_py(), depth)
        if same:
            np.fill_diagonal(hit, False)
        links[rows] += hit @ weight[columns]
        if not same:
            links[columns] += weight[rows] @ hit
        r, c = np.nonzero(hit)
        step = np.clip(((shared[r, c] / union[r, c] - threshold) / max(1 - threshold, 1e-9) * STEPS).astype(int), 0, STEPS - 1)
        np.add.at(histogram, (rows[r], step), 1)
        while len(r):  # the least rank that a set is linked to, until nothing moves
            old, far = root.copy(), len(keys)
            root[rows] = np.minimum(root[rows], np.where(hit, root[columns][None, :], far).min(axis=1, initial=far))
            root[columns] = np.minimum(root[columns], np.where(hit, root[rows][:, None], far).min(axis=0, initial=far))
            root = np.minimum(root, root[order[root]])
            if (root == old).all():
                break
    return pa.table({"fp": pa.array(keys, pa.binary()), "links": pa.array(links), "root": pa.array([keys[order[r]] for r in root], pa.binary()), "histogram": pa.array(histogram.tolist(), pa.list_(pa.int64()))})


#: What a group of candidates is known by: a node of a tree, and two of its blocks.
GROUP = ("tree", "node", "x", "y")


def compare_at(depth: int, classes: DataFrame, rows: DataFrame, threshold: float, words: int) -> DataFrame:
    """fp, links, root, histogram: what prefixes of ``depth`` add, a row or more a set."""
    def node(tree: int) -> Column:
        return F.xxhash64(F.lit(tree), F.substring("sig", tree * DEPTH * 4 + 1, depth * 4))

    entries = classes.filter("n > 0").select("fp", "n", F.posexplode(F.array(*map(node, range(TREES)))).alias("tree", "node"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    shared = entries.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("c"), blocks.alias("n_blocks")).filter("c > 1").drop("c")
    at = entries.join(shared, ["tree", "node"]).groupBy("fp").agg(F.collect_list(F.struct("tree", "node", "n_blocks")).alias("at"))  # at most a row a tree
    block, other = F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int"), F.col("other")
    met = at.join(classes.select("fp", "sig"), "fp").select("fp", "sig", F.explode("at").alias("at")).select("fp", "sig", "at.*").withColumn("block", block)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    met = met.select("fp", "sig", "tree", "node", F.least("block", other).alias("x"), F.greatest("block", other).alias("y"), "block")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(needed(g, depth) for g in in_groups(batches, GROUP) if g.num_rows > 1)

    group = "fp binary, tree int, node bigint, x int, y int, block int"
    wanted = met.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(look, group)
    wanted = staged(wanted.groupBy("fp").agg(F.collect_list(F.struct(*GROUP, "block")).alias("at")))

    # Only texts of sets that are compared are shuffled.
    members = staged(wanted.join(classes, "fp").select("fp", "sig", "weight", "at", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")))
    bits = staged(filter_of(members.select(F.xxhash64("rep_id", "rep_hash").alias("hash"))))
    texts = passing(rows.withColumn("hash", F.xxhash64("doc_id", "text_hash")), bits).distinct()
    texts = texts.join(members, F.col("doc_id").eqNullSafe(F.col("rep_id")) & F.col("text_hash").eqNullSafe(F.col("rep_hash")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = pa.array([shingles(t.as_py(), words).view(np.int64) for t in batch.column(4)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], found], ["fp", "sig", "weight", "at", "shingles"])

    place = "array<struct<tree:int,node:bigint,x:int,y:int,block:int>>"
    sets = texts.select("fp", "sig", "weight", "at", "text").mapInArrow(cut, f"fp binary, sig binary, weight bigint, at {place}, shingles array<bigint>")
    dealt = sets.select("fp", "sig", "weight", "shingles", F.explode("at").alias("at")).select("fp", "sig", "weight", "shingles", "at.*")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(compare(g, depth, threshold) for g in in_groups(batches, GROUP))

    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(count, "fp binary, links bigint, root binary, histogram array<bigint>")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, group_size, n_links, text_hash
    (xxhash64 of the text), stays (whether the row represents its class: that of
    the smallest id, then text_hash; rows that repeat both stay together).

    Two texts are linked if the Jaccard similarity of their sets of ``words``-word
    shingles is ``threshold`` or more; words are separated by white space, in
    lower case. n_links is the number of other rows linked to a row, copies among
    them; class_id is the smallest doc_id of all rows that links connect, group_size
    their number. A text of fewer words is one shingle; texts without any word
    (null, empty) are copies of each other. Repeated rows are copies too; a class
    without any id has a null class_id. Extra columns are ignored; an empty table
    gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [shingles(t.as_py(), words) for t in batch.column(1)]
            sigs = [signature(s) if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([fingerprint(s) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64()), pa.array(sigs, pa.binary())],
                ["doc_id", "text_hash", "fp", "n", "sig"],
            )

    signed = staged(rows.mapInArrow(sign, f"doc_id {kind}, text_hash bigint, fp binary, n bigint, sig binary"))
    classes = staged(signed.groupBy("fp").agg(F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("rep")))

    compared, histogram = None, np.zeros(STEPS, np.int64)
    for depth in range(DEPTH, 0, -1):
        part = staged(compare_at(depth, classes, rows, threshold, words))
        compared = part if compared is None else compared.unionByName(part)
        sums = part.agg(*(F.sum(F.get("histogram", F.lit(k))) for k in range(STEPS))).first()
        histogram += np.array([n or 0 for n in sums])
        if max(recall(threshold, TREES, depth), expected_recall(histogram, threshold, TREES, depth)) >= target:
            break

    joined = components(compared.select(F.col("fp").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"a": "fp", "b": "root"})
    links = compared.groupBy("fp").agg(F.sum("links").alias("links"))
    found = classes.select("fp", "weight", "rep").join(joined, "fp", "left").join(links, "fp", "left")
    found = found.select("fp", "weight", "rep", F.coalesce("root", "fp").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    groups = found.groupBy("root").agg(F.min("rep").alias("stays"), F.sum("weight").alias("group_size"))
    found = found.join(groups, "root").select("fp", "stays", "group_size", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    out = signed.select("doc_id", "text_hash", "fp").join(found, "fp")
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & F.col("text_hash").eqNullSafe(F.col("stays.text_hash"))
    return out.select("doc_id", F.col("stays.doc_id").alias("class_id"), "group_size", "n_links", "text_hash", stays.alias("stays"))
