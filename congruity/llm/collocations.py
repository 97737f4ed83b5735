"""Collocations: word sequences that stand together more often than their parts suggest.

Every sequence of one to some words is counted in a sketch first: a row of 2 ** CELL_BITS
cells of which only those that occur are kept, dealt over the tasks, so that it never
counts less than there is and grows with the input. Cells that reach the least count are
marked in a filter, and a sequence with a mark is a candidate. Each task then writes its
texts in codes, two letters a word, compiles the candidates among them into automata and
scans the texts, overlapping matches included. The counts of all tasks are summed, and
the exact counts decide: sketch and filter may only add candidates in vain. Texts are
read twice, whatever their number and that of the candidates.
"""

from __future__ import annotations

import secrets
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, in_slices, staged
from .word_names import mixed, sequence_names, word_names

#: Cells of the sketch are 2 ** CELL_BITS, whatever the input, in 2 ** SHARD_BITS shards. A
#: shard's marks are 8 to 16 bits for each cell that reaches the least count, and at most
#: 2 ** MARK_BITS, so that all of them stay below 128 MB.
CELL_BITS, SHARD_BITS, MARK_BITS = 44, 12, 18
#: Bytes of text taken together; sequences that a task counts before it passes them on;
#: candidates, and words of text, that a task holds before an automaton counts them.
PORTION, HELD, REMEMBERED, BLOCK = 1 << 22, 1 << 22, 1 << 19, 1 << 22
#: Parts of a language's counts; phrases of a batch; bytes of text for each task that sums.
PARTS, ROW, DEALT = 1024, 1 << 16, 32 << 20
#: The second letter of a word's code is one of CODES, the first tells the rest.
CODES = 512
#: What ends a piece of text.
ENDS = b".,;:!?\n\x0b\x0c\r"
LETTERS = bytes.maketrans(UPPER.encode() + b"\t" + ENDS, UPPER.lower().encode() + b" " + b"\n" * len(ENDS))


def normalised(text: bytes) -> bytes:
    """Lower-cased words with one blank before and behind each; a line feed among
    them ends a piece."""
    out = b" " + text.translate(LETTERS).replace(b"\n", b" \n ") + b" "
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


class Sequences:
    """Hashes of all word sequences of some normalised texts of one language."""

    def __init__(self, lang: str, texts: list[bytes], key: int):
        self.data = b"\n".join([b" ", *texts, b" "])
        self.words, self.start, self.end = word_names(self.data, key)
        self.ends = (self.end - self.start == 1) & (np.frombuffer(self.data, np.uint8)[self.start] == 10)
        self.lang, self.key = np.uint64(int.from_bytes(blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")), key

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the sequences of ``n`` words inside a piece."""
        hashes, inside = sequence_names(self.words, n, self.key), ~self.ends
        whole = reduce(np.logical_and, (inside[k : k + len(hashes)] for k in range(n)))
        first = np.flatnonzero(whole)
        return first, mixed(hashes[first] ^ self.lang)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Normalised texts of one language, about PORTION bytes at a time; longer ones fall
    apart where a piece ends. All languages' texts together stay below some PORTIONs."""
    texts, size = defaultdict(list), Counter()
    for part in in_slices(batches):
        for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            rest = normalised(text.as_py())
            while rest:
                cut = rest.find(b"\n", PORTION) + 1 or len(rest)
                texts[lang].append(rest[:cut])
                size[lang] += cut
                rest = rest[cut:]
                if size[lang] >= PORTION:
                    yield lang, texts.pop(lang)
                    del size[lang]
        while size.total() >= 4 * PORTION:
            ((lang, _),) = size.most_common(1)
            yield lang, texts.pop(lang)
            del size[lang]
    yield from texts.items()


def cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards of the cells, and their places in them."""
    cell, place_bits = hashes >> np.uint64(64 - bits), np.uint64(bits - min(SHARD_BITS, bits))
    return (cell >> place_bits).astype(np.int64), cell & ((np.uint64(1) << place_bits) - np.uint64(1))


def marks_of(places: np.ndarray, masks: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each place among ``masks`` + 1 of its shard."""
    hashed = mixed(places)
    return (hashed & masks).astype(np.int64), ((hashed >> np.uint64(32)) & masks).astype(np.int64)


def sketch(texts: DataFrame, longest: int, least: int, bits: int, key: int, tasks: int) -> dict[str, np.ndarray]:
    """Marks of the cells that reach ``least``: bits, and where those of a shard start and
    how many they are, less one. Their size is bounded, so they may pass the driver."""
    enough = min(least, 255)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for lang, found in portions(batches):
            own = Sequences(lang, found, key)
            held += [own.of(n)[1] for n in range(1, longest + 1)]
            if sum(map(len, held)) >= HELD:
                yield counted(held)
                held = []
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held) >> np.uint64(64 - bits) << np.uint64(64 - bits), return_counts=True)
        shard, place = cells(found, bits)
        border = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(found) else np.zeros(1, np.int64)
        place, n = place.astype("<u4"), np.minimum(n, enough).astype(np.uint8)
        runs = list(zip(border[:-1].tolist(), border[1:].tolist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(shard[border[:-1]].astype(np.int32)), pa.array([place[a:b].tobytes() for a, b in runs], pa.binary()), pa.array([n[a:b].tobytes() for a, b in runs], pa.binary())], ["shard", "places", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(lambda: ([], []))
        for batch in batches:
            for shard, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[shard][0].append(places)
                held[shard][1].append(counts)
        for shard in list(held):
            places, counts = map(b"".join, held.pop(shard))
            both = np.frombuffer(places, "<u4").astype(np.uint64) << np.uint64(8) | np.frombuffer(counts, np.uint8)
            both.sort()
            first = np.flatnonzero(np.diff(both >> np.uint64(8), prepend=~both[:1]))
            reached = both[first][np.add.reduceat((both & np.uint64(255)).astype(np.int64), first) >= enough] >> np.uint64(8)
            if len(reached):
                marks = np.zeros(1 << min(max((8 * len(reached) - 1).bit_length(), 3), MARK_BITS), bool)
                for at in marks_of(reached, np.uint64(len(marks) - 1)):
                    marks[at] = True
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(marks).tobytes()], pa.binary())], ["shard", "bits"])

    shards = staged(texts.mapInArrow(count, "shard int, places binary, counts binary").repartition(tasks, "shard").mapInArrow(added, "shard int, bits binary"))
    out, size = [b"\0"], 8  # what a shard without marks has
    start, mask = np.zeros(1 << min(SHARD_BITS, bits), np.int64), np.full(1 << min(SHARD_BITS, bits), 7, np.uint64)
    for shard in shards.toLocalIterator():
        out.append(bytes(shard["bits"]))
        start[shard["shard"]], mask[shard["shard"]] = size, 8 * len(out[-1]) - 1
        size += 8 * len(out[-1])
    return {"bits": np.frombuffer(b"".join(out), np.uint8), "start": start, "mask": mask}


def reaches(marks: dict[str, np.ndarray], hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether both marks of each hash's cell are set."""
    shard, place = cells(hashes, bits)
    out = np.ones(len(hashes), bool)
    for at in marks_of(place, marks["mask"][shard]):
        at += marks["start"][shard]
        out &= (marks["bits"][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


class Block:
    """Some texts of one language in codes of their words, and the candidates in them.
    Codes of different words differ, and a code's first letter is never a second one, so
    that equal codes are equal words at a word's start."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, names, how often
        self.phrases: dict[str, int] = {}  # and their names
        self.texts: list[str] = []
        self.size = 0

    def add(self, own: Sequences, longest: int, marks: dict[str, np.ndarray], bits: int) -> None:
        first, hashes = own.of(1)
        names, at, back, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        kept = np.flatnonzero(reaches(marks, names, bits))
        # Frequent words come first: an automaton tries its letters in their order.
        kept = kept[np.argsort(-n[kept], kind="stable")]
        where = first[at[kept]]
        new = np.array([self.codes.setdefault(own.data[a:b], len(self.codes)) for a, b in zip(own.start[where].tolist(), own.end[where].tolist(), strict=True)], np.int64)
        self.seen.append((new, names[kept], n[kept]))
        number = np.full(len(names), -1)
        number[kept] = new
        words = np.full(len(own.words), -1)
        words[first] = number[back]
        letters = np.stack([words // CODES + CODES + 1, words % CODES + 1], 1).astype("<u4")
        letters[words < 0] = 0  # stands in no phrase that reaches the least count
        text = letters.tobytes().decode("utf-32-le", "surrogatepass")
        for n in range(2, longest + 1):
            first, hashes = own.of(n)
            marked = reaches(marks, hashes, bits) & reduce(np.logical_and, (words[first + k] >= 0 for k in range(n)))
            names, at = np.unique(hashes[marked], return_index=True)
            where = 2 * first[marked][at]
            self.phrases.update(zip([text[k : k + 2 * n] for k in where.tolist()], names.tolist(), strict=True))
        self.texts.append(text)
        self.size += len(words)

    def count(self) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """Parts of the candidates, words and phrases, and all their occurrences in the
        texts. Equal phrases have one part in all blocks."""
        import ahocorasick

        phrases, n_words = list(self.phrases), len(self.codes)
        counts, names = np.zeros((2, n_words + len(phrases)), np.uint64)
        for number, name, n in self.seen:
            names[number] = name
            counts[number] += n.astype(np.uint64)
        names[n_words:] = list(self.phrases.values())
        if phrases:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, phrase in enumerate(phrases, n_words):
                automaton.add_word(phrase, k)
            automaton.make_automaton()
            for text in self.texts:
                matches = map(itemgetter(1), automaton.iter(text))
                while len(part := np.fromiter(islice(matches, HELD), np.int64)):
                    counts += np.bincount(part, minlength=len(counts)).astype(np.uint64)
        # Words of the phrases, part by part: a line feed follows the last one of each.
        parts = names % np.uint64(PARTS)
        order = np.argsort(parts, kind="stable")
        letters = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64).reshape(-1, 2)
        numbers = np.concatenate([np.arange(n_words), (letters[:, 0] - CODES - 1) * CODES + letters[:, 1] - 1])
        size = np.concatenate([np.ones(n_words, np.int64), np.fromiter(map(len, phrases), np.int64, len(phrases)) // 2])
        start, size = (np.cumsum(size) - size)[order], size[order]
        last = np.cumsum(size) - 1
        own = numbers[np.repeat(start - last + size - 1, size) + np.arange(int(size.sum()))]
        own[last] += n_words
        words = [w + b" " for w in self.codes] + [w + b"\n" for w in self.codes]
        border = np.flatnonzero(np.diff(parts[order], prepend=PARTS, append=PARTS)) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
            found = own[last[a] - size[a] + 1 : last[b - 1] + 1].tolist()
            yield int(parts[order[a]]), b"".join(map(words.__getitem__, found))[:-1], counts[order[a:b]].astype("<i8")


def counts_of(texts: DataFrame, marks: Broadcast, longest: int, least: int, bits: int, key: int, tasks: int) -> DataFrame:
    """lang, phrase, f of every word and phrase that occurs ``least`` times, and for each
    language a row without a phrase, where f is its number of words. A row of the shuffle
    has many phrases."""
    schema = ["lang", "part", "phrases", "counts"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, words = defaultdict(Block), Counter()
        n_words = n_phrases = 0
        for lang, found in portions(batches):
            own, block = Sequences(lang, found, key), blocks[lang]
            words[lang] += len(own.words) - int(own.ends.sum())
            n_words, n_phrases = n_words - block.size, n_phrases - len(block.phrases)
            block.add(own, longest, marks.value, bits)
            n_words, n_phrases = n_words + block.size, n_phrases + len(block.phrases)
            while n_words >= BLOCK or n_phrases >= REMEMBERED:
                largest = max(blocks, key=lambda k: blocks[k].size)
                block = blocks.pop(largest)
                n_words, n_phrases = n_words - block.size, n_phrases - len(block.phrases)
                yield packed(largest, block)
        for lang in list(blocks):
            yield packed(lang, blocks.pop(lang))
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array([-1] * len(words), pa.int32()), pa.nulls(len(words), pa.binary()), pa.array([np.array([n], "<i8").tobytes() for n in words.values()], pa.binary())], schema)

    def packed(lang: str, block: Block) -> pa.RecordBatch:
        found = list(block.count())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([part for part, _, _ in found], pa.int32()), pa.array([blob for _, blob, _ in found], pa.binary()), pa.array([counts.tobytes() for _, _, counts in found], pa.binary())], schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = defaultdict(Counter), Counter()
        for batch in batches:
            for lang, part, blob, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    words[lang] += int(np.frombuffer(own, "<i8")[0])
                else:
                    sums = counts[lang]
                    for phrase, n in zip(blob.split(b"\n"), np.frombuffer(own, "<i8").tolist(), strict=True):
                        sums[phrase] += n
        for lang in list(counts):
            found = iter([(phrase, n) for phrase, n in counts.pop(lang).items() if n >= least])
            while some := list(islice(found, ROW)):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([phrase for phrase, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], ["lang", "phrase", "f"])
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.nulls(len(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["lang", "phrase", "f"])

    dealt = texts.mapInArrow(find, "lang string, part int, phrases binary, counts binary").repartition(tasks, "lang", "part")
    return dealt.mapInArrow(merge, "lang string, phrase binary, f bigint").select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, held_percent: int = 50, lang_col: str = "lang", text_col: str = "text", cell_bits: int = CELL_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2
    to ``longest`` words by score, a, phrase.

    Texts lose the case of A-Z and fall into pieces at ENDS and into words at blanks and
    tabs. a counts all occurrences inside pieces, overlaps included, at least ``least``;
    n counts the language's words. A cut gives l and r, the counts of its parts, and the
    score floor(1000000 * a * a / (l * r)); the cut of the least score counts, of equal
    ones the first. Phrases that stand inside a longer one of the least count and of
    ``held_percent`` of their occurrences go. Numbers are exact: decimals of 38 digits,
    which hold for a below 10 ** 16; beyond that the run stops.

    Null texts are empty, null languages `und`, together with rows that say so. Repeated
    rows count each. Words of any length take part. Extra columns are ignored; an empty
    table, or one without such phrases, gives an empty result.
    """
    spark, key = docs.sparkSession, secrets.randbits(62)
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    tasks = 1 + size // DEALT
    marks = spark.sparkContext.broadcast(sketch(texts, longest, least, cell_bits, key, tasks))
    found = staged(counts_of(texts, marks, longest, least, cell_bits, key, tasks))

    split = F.split("phrase", " ")
    enough = found.filter("phrase IS NOT NULL").withColumn("words", F.size(split))

    def joined(first: Column, n: Column) -> Column:
        return F.array_join(F.slice(split, first, n), " ")

    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), joined(F.lit(1), k).alias("head"), joined(k + 1, F.col("words") - k).alias("tail")))
    cut = enough.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.inline(cuts))
    for part, n in (("head", "l"), ("tail", "r")):
        cut = cut.join(enough.select("lang", F.col("phrase").alias(part), F.col("f").alias(n)), ["lang", part])
    exact = cut.withColumn("score", F.expr("(CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0)) * CAST(1000000 AS DECIMAL(7,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    scored = exact.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least")).select("lang", "phrase", "a", "least.l", "least.r", "least.score")

    def inside(n: Column) -> Column:
        """The parts of ``n`` words of a phrase."""
        return F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda k: joined(k, n))

    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), inside))
    longer = enough.filter("words > 2").select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {held_percent} * a")
    # A language's best go through one task: at most 64 times ``top``, whatever its size.
    order = (F.desc("score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(f"rank <= {top}")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    n = found.filter("phrase IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    best = kept.withColumn("rank", rank.cast("long")).filter(f"rank <= {top}")
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
