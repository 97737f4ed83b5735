"""Token ids in Parquet files that allow selective reads.

Documents are dealt out by ranges of doc_id and sorted, encoded where they lie,
and written as list columns: ids dictionary-encoded, the other columns in delta
encoding, with small pages, page indexes and bounded row groups. A reader that
asks for a few documents or only for metadata skips the rest.
"""

from __future__ import annotations

import gc
import os
import string
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex as re
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import LONG, SPACES, byte_letters

END = 0
#: The pattern of the vocabulary's tokenizer.
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
PUNCTUATION = string.punctuation
OTHER_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
OTHER_LATIN = OTHER_ASCII + "\x85\xa0"
#: Kinds of characters: what pieces are made of, other white space, and what Python does
#: not know, which the library may know.
COMMON, SPACE, UNKNOWN = 0, 1, 2
#: Pieces of a generation that a worker remembers; longer ones than LONG are not.
REMEMBERED = 300_000
#: Characters of the texts that are encoded together.
CHUNK = 4 << 20
FORMAT = {
    "compression": "snappy",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "1000",
}


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of each code point."""
    out = np.full(0x110000, COMMON, np.uint8)
    for c in range(0x110000):
        letter = chr(c)
        if unicodedata.category(letter) == "Cn":
            out[c] = UNKNOWN
        elif letter not in " \n" and (letter.isspace() or letter in SPACES):
            out[c] = SPACE
    return out


def kind_of(text: str) -> int:
    """The most unusual kind of the characters of a text."""
    spaces = OTHER_ASCII
    if not text.isascii():
        try:
            text.encode("latin-1")
            spaces = OTHER_LATIN
        except UnicodeEncodeError:
            return int(kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].max())
    return SPACE if any(c in text for c in spaces) else COMMON


class Remembered(dict):
    """Values by key, found by ``find`` at first sight. When full, what it holds
    becomes the older generation, from which keys in use come back."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONG:
            return self.find(key)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        out = self.older.get(key) or self.find(key)
        self[key] = out
        return out


class PieceEncoder:
    """The model of the tokenizers library over distinct pieces of texts.

    A piece is what stands between blanks, with the blank before it (written as
    none) or with the line break before it: the tokenizer's own pattern never
    joins characters of two pieces. Texts with other white space are cut by the
    pattern itself; texts with special tokens, or with code points that Python does not
    know, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.seen, self.ends = Remembered(self.piece), Remembered(self.ids)
        self.words = Remembered(self.word)

    def word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        return array("i", [t.id for t in self.tokenize(letters)]).tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, WORD.findall(text)))

    def piece(self, piece: str) -> bytes:
        """Ids of a piece; letters with punctuation behind them are two words."""
        broken = piece[:1] == "\n"
        rest = piece[1:] if broken else piece
        stem = rest.rstrip(PUNCTUATION)
        if not stem.isalpha():
            return self.ids(piece if broken else " " + piece)
        if stem != rest:
            return self.seen["\n" + stem if broken else stem] + self.ends[rest[len(stem) :]]
        word = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
        found = array("i", [t.id for t in self.tokenize(word if broken else "Ġ" + word)]).tobytes()
        return self.ends["\n"] + found if broken else found

    def is_plain(self, text: str, kind: int) -> bool:
        """Whether blanks and line breaks are all the white space, one at a time and
        inside the text, and no special token stands in it."""
        if kind != COMMON or any(s in text for s in self.special) or text[:1] in " \n" or text[-1:] in " \n":
            return False
        return not ("  " in text or "\n " in text or " \n" in text or "\n\n" in text)

    def encode(self, text: str) -> bytes:
        kind = kind_of(text)
        if self.is_plain(text, kind):
            pieces = text.replace("\n", " \n").split(" ")
            return self.ends[pieces[0]] + b"".join(map(self.seen.__getitem__, pieces[1:]))
        if kind == UNKNOWN or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<i4").tobytes()
        return self.ids(text)

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has. Each
        piece of the plain ones is looked up once, and once more where it begins a text."""
        plain = [self.is_plain(t, kind_of(t)) for t in texts]
        lists = pc.split_pattern(pa.array([t.replace("\n", " \n") for t, ok in zip(texts, plain, strict=True) if ok], pa.string()), " ")
        codes, offsets = lists.values.dictionary_encode(), lists.offsets.to_numpy()
        pieces, at = codes.dictionary.to_pylist(), codes.indices.to_numpy().astype(np.int64)
        begins = offsets[:-1]
        firsts = [self.ends[pieces[k]] for k in at[begins].tolist()]
        at[begins] = len(pieces) + np.arange(len(firsts))
        follows = np.bincount(at, minlength=len(pieces))[: len(pieces)] > 0
        found = [self.seen[p] if used else b"" for p, used in zip(pieces, follows.tolist(), strict=True)] + firsts
        size = np.array([len(x) // 4 for x in found], np.int64)
        start = np.cumsum(size) - size
        many = size[at]
        ends = np.cumsum(many)
        ids = np.frombuffer(b"".join(found), "<i4")[np.repeat(start[at] - ends + many, many) + np.arange(int(many.sum()))]
        border = np.concatenate(([0], ends))[offsets]
        if all(plain):
            return ids, np.diff(border)
        spans = iter(zip(border[:-1].tolist(), border[1:].tolist(), strict=True))
        parts = [ids[slice(*next(spans))] if ok else np.frombuffer(self.encode(t), "<i4") for t, ok in zip(texts, plain, strict=True)]
        return np.concatenate([np.zeros(0, "<i4"), *parts]), np.array([len(p) for p in parts], np.int64)


@lru_cache(1)
def piece_encoder(path: str) -> PieceEncoder:
    # Encoding makes many short-lived lists and no cycles: the collector would walk over
    # the remembered pieces again and again.
    gc.set_threshold(1_000_000)
    return PieceEncoder(path)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes doc_id, part, first (ids before it in its part), n_tokens and ids to ``path``.

    Rows ascend by ``id_col`` over the parts and within them; nulls come first,
    and rows of equal id are ordered by a hash of their text, repeated rows by where
    they were read, so that rows of one id may lie in many parts. Every document,
    empty or null ones too, ends with id 0. ``vocabulary`` is a path that every
    executor can open. Extra columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, first = piece_encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, size, begin = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= CHUNK or k + 1 == batch.num_rows:
                    ids, n = own.encode_many(texts)
                    flat = np.insert(ids, np.cumsum(n), END)
                    offsets = np.concatenate(([0], np.cumsum(n + 1)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(begin, len(n)), pa.array(np.full(len(n), part, np.int32)), pa.array(offsets[:-1] + first), pa.array(n + 1), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))],
                        ["doc_id", "part", "first", "n_tokens", "ids"],
                    )
                    first += int(offsets[-1])
                    texts, size, begin = [], 0, k + 1

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    order = ("doc_id", "tie", "at")
    dealt = rows.withColumns({"tie": F.xxhash64("text"), "at": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    encoded = dealt.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part int, first bigint, n_tokens bigint, ids array<int>")
    encoded.write.options(**FORMAT).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids.

    The starts of the parts are a running sum over one row a part.
    """
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows that read_token_files() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
