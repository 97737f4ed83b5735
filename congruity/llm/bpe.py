"""Byte-pair encoding by backtracking, and decoding by an offset table.

The vocabulary file is that of a public tokenizer whose words end in ``</w>`` and
whose token ids follow the order of its merges. Words are strings over 512
symbols: a byte, or a last byte. One pass of an Aho-Corasick automaton over a word
finds the longest token at every place; a token is taken if it can stand behind the
one before it, which a table of compatible pairs says (filled as pairs turn up); if
not, shorter prefixes are tried, and with none left the encoder steps back. This
gives the same tokens as merging pairs by rank, in linear time.

The library that defines the ids knows other versions of Unicode than Python does.
Pieces with a character on which they may differ (unassigned here, or combined in
another way there) are normalised and cut into words by the library itself.
"""

from __future__ import annotations

import gc
import json
import string
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

#: The white space and the word pattern of the vocabulary's tokenizer.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Pieces that a worker remembers before it starts anew, characters of the longest one
#: that it remembers, and bytes of output to a batch.
REMEMBERED, LONG, BATCH_BYTES = 200_000, 64, 16 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@lru_cache(1)
def unsure() -> np.ndarray:
    """Which code points Python and the library may treat differently."""
    out = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
    library = normalizers.NFC()

    def differs(text: str) -> bool:
        return library.normalize_str(text) != unicodedata.normalize("NFC", text)

    for c in range(0x300, 0x110000):
        if out[c] or 0xAC00 <= c < 0xE000:  # syllables and surrogates follow a rule
            continue
        x = chr(c)
        if unicodedata.category(x)[0] == "M":  # before and behind marks of other classes
            out[c] = any(differs(t) for t in (f"a{x}\u0301", f"a\u0345{x}", f"a\u0334{x}\u0301", f"a\u0301{x}\u0323"))
        parts = unicodedata.decomposition(x)
        if parts and parts[0] != "<" and (differs(x) or differs(unicodedata.normalize("NFD", x))):
            out[[c, *(ord(p) for p in unicodedata.normalize("NFD", x))]] = True
    return out


class Encoder:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.of_byte = of_byte = {c: b for b, c in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            last = token.endswith(WORD_END)
            codes = [of_byte[c] for c in (token.removesuffix(WORD_END) if last else token)]
            return "".join(map(chr, codes[:-1])) + chr(codes[-1] + 256 * last)

        n = max([*vocab.values(), *self.special.values()]) + 1
        self.text, self.parts, self.whole = [""] * n, [(i, i) for i in range(n)], {}
        names = [b""] * n
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            names[i] = token.encode()
            self.text[i] = symbols(token)
            self.automaton.add_word(self.text[i], i)
        self.automaton.make_automaton()
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            i = vocab[a + b]
            self.parts[i] = vocab[a], vocab[b]
            self.whole[vocab[a], vocab[b]] = i
        self.ids = {s: i for i, s in enumerate(self.text) if s}
        self.prefix, self.length = [-2] * n, [len(s) for s in self.text]
        self.compatible: dict[tuple[int, int], bool] = {}
        for token, i in self.special.items():
            names[i] = token.encode()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.spaces, self.control = regex.compile(f"[{SPACES}]+"), regex.compile("[\x1c-\x1f]")
        self.word = regex.compile(WORD.replace(r"\s", SPACES))
        # Decoding: the token of id i is blob[offset[i]:offset[i + 1]], with a blank after it.
        self.offset = np.concatenate(([0], np.cumsum([len(x) + 1 for x in names])))
        self.blob = np.frombuffer(b"".join(x + b" " for x in names), np.uint8)
        self.seen: dict[str, bytes] = {}
        self.unsure = unsure()

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if (known := self.prefix[token]) == -2:
            s = self.text[token]
            known = self.prefix[token] = next((self.ids[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.ids), -1)
        return None if known < 0 else known

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between the two tokens standing."""
        if (known := self.compatible.get((left, right))) is not None:
            return known
        a, b, before, ok = left, right, len(self.text), None
        # Undo the younger merge of the two at the border, again and again: the border
        # falls if the pieces on its sides merge before the piece that was undone.
        while ok is None:
            if self.whole.get((a, b), before) < before:
                ok = False
            else:
                undo_left = self.parts[a] != (a, a) and (a > b or self.parts[b] == (b, b))
                if undo_left:
                    before, a = a, self.parts[a][1]
                elif self.parts[b] != (b, b):
                    before, b = b + 1, self.parts[b][0]
                else:
                    ok = True
        if len(self.compatible) > 2 * REMEMBERED:
            self.compatible.clear()
        self.compatible[left, right] = ok
        return ok

    def longest(self, word: str) -> list[int]:
        """The longest token that starts at each place of ``word``."""
        out, length = [0] * len(word), self.length
        for end, token in self.automaton.iter(word):  # ends ascend, so the last of a start is the longest
            out[end + 1 - length[token]] = token
        return out

    def word_ids(self, data: bytes) -> list[int]:
        s = data[:-1].decode("latin-1") + chr(data[-1] + 256)
        if (token := self.ids.get(s)) is not None:
            return [token]
        found: list[int] = []
        length, compatible, longest, n = self.length, self.compatible, self.longest(s), len(s)
        closed: set[int] = set()  # places from which no tokens can follow
        pos, token = 0, longest[0]
        while pos < n:
            while token is not None:
                end = pos + length[token]
                if end not in closed and (not found or compatible.get((pair := (found[-1], token))) or pair not in compatible and self.fits(*pair)):
                    break
                token = self.shorter(token)
            if token is not None:
                found.append(token)
                pos = end
                token = longest[pos] if pos < n else None
            else:  # nothing can stand here: the token before was too long
                closed.add(pos)
                token = found.pop()
                pos -= length[token]
        return found

    def piece(self, piece: str) -> bytes:
        """Ids of a normalised piece without white space, as little-endian 32-bit
        integers; letters with punctuation behind them are two words."""
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        stem = piece.rstrip(string.punctuation)
        if stem != piece and stem.isalpha():
            end = piece[len(stem) :]
            return (self.seen.get(stem) or self.piece(stem)) + (self.seen.get(end) or self.piece(end))
        words = [piece] if stem.isalpha() else self.word.findall(piece)
        if len(words) == 1:
            out = array("I", self.word_ids(words[0].encode())).tobytes()
        else:
            out = b"".join(self.seen.get(w) or self.piece(w) for w in words)
        if len(piece) <= LONG:
            self.seen[piece] = out
        return out

    def cut_by_library(self, piece: str) -> bytes:
        """Ids of a raw piece without white space, cut into words by the library."""
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return array("I", [i for w, _ in words for i in self.word_ids(bytes(self.of_byte[c] for c in w))]).tobytes()

    def normalised(self, text: str) -> bytes:
        text = (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()
        pieces = [p for p in self.spaces.split(text) if p] if self.control.search(text) else text.split()
        get, piece = self.seen.get, self.piece
        return b"".join([get(p) or piece(p) for p in pieces])

    def is_unsure(self, text: str) -> bool:
        return not text.isascii() and bool(self.unsure[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any())

    def encode(self, text: str) -> bytes:
        out = []
        for part in self.split_special.split(text) if self.split_special and "<|" in text else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif self.is_unsure(part):
                out += [self.cut_by_library(p) if self.is_unsure(p) else self.normalised(p) for p in self.spaces.split(part) if p]
            else:
                out.append(self.normalised(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The tokens of ``ids`` with blanks between them."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(at):
            return b""
        start, size = self.offset[at], self.offset[at + 1] - self.offset[at]
        ends = np.cumsum(size)
        return self.blob[np.repeat(start - ends + size, size) + np.arange(ends[-1])][:-1].tobytes()


@lru_cache(1)
def encoder(path: str) -> Encoder:
    gc.set_threshold(1_000_000)  # many short-lived lists, no cycles
    return Encoder(path)


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """``id_col``, n_tokens, ids (binary: little-endian unsigned 32-bit integers) and,
    if ``decode``, decoded (the tokens of those ids, separated by blanks).

    ``vocabulary`` is a path that every executor can open. Null and empty texts
    give no ids and an empty decoded text. Rows are encoded one by one, so
    repeated and null ids stay as they are; extra columns are ignored; an empty
    table gives an empty result. Nothing is shuffled, truncated or padded.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            ids, plain, size, first = [], [], 0, 0

            def out(end: int) -> pa.RecordBatch:
                columns = [batch.column(0).slice(first, end - first), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                names = [id_col, "n_tokens", "ids"]
                if decode:
                    columns.append(pa.array(plain, pa.binary()).cast(pa.string()))
                    names.append("decoded")
                return pa.RecordBatch.from_arrays(columns, names)

            for k, text in enumerate(batch.column(1)):
                ids.append(own.encode(text.as_py() or ""))
                if decode:
                    plain.append(own.decode(ids[-1]))
                size += len(ids[-1]) + (len(plain[-1]) if decode else 0)
                if size >= BATCH_BYTES:
                    yield out(k + 1)
                    ids, plain, size, first = [], [], 0, k + 1
            if ids:
                yield out(batch.num_rows)

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids binary" + ", decoded string" * decode
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
