"""The training-data operators against brute force, on small tables with odd rows."""

import hashlib
import importlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from congruity.llm import quality, queries
from congruity.llm.bpe import Encoder, bpe_encode
from congruity.llm.chat_format import escape, format_chats, read_back, read_turns, unescape
from congruity.llm.common import ascii_lower, filter_of, passing, shared_dir
from congruity.llm.components import components
from congruity.llm.decontaminate import MATCH, align, decontaminate
from congruity.llm.decontaminate import blocks as items_in_blocks
from congruity.llm.exact_dedup import Index, exact_dedup, sha256
from congruity.llm.html_text import ENTRIES, html_text, main_text, neighbours, repeats_of, runs, suffix_array
from congruity.llm.jaccard_join import DEPTH, TREES, expected_recall, first_met, jaccard_join, read_signatures, recall, shingles, signature
from congruity.llm.license_scan import BASE_PHRASES, license_scan, rare_offsets, template_words
from congruity.llm.license_texts import TEMPLATES
from congruity.llm.suffix_dedup import SEGMENT, intervals, sample, solve, suffix_dedup
from congruity.llm.token_files import COMMON, FORMAT, SPACE, UNKNOWN, PieceEncoder, kinds, read_token_files, with_crc32, write_token_files

suffix_module, jaccard_module = (importlib.import_module(f"congruity.llm.{n}") for n in ("suffix_dedup", "jaccard_join"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE_BPE, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
RNG = random.Random(3)
WORDS = ["the", "mit", "under", "license", "version", "2", "apache", "Ça", "naïve", "東京", "cc", "by", "nc", "of", "and", "lorem", "ipsum", "dolor", "sit", "amet"]


def prose(n, rng=RNG, extra=400):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.3 else f"w{rng.randrange(extra)}x" for _ in range(n))


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in zip(ids, texts, strict=True)], DOCS)


ODD = [None, "", " ", "\n\t", "A", "a", "É", "é", "a" * 3000, "ab " * 700, "<|endoftext|> x  <|startoftext|>", "😀 \u0000 \x1c y", "The MIT License", "the mit license"]
NOTHING = "doc_id long, text string, id string, word string, digest string, label string, score double"


# Exact dedup

def test_exact_dedup(spark):
    texts = ODD + ["Same Text", "same text", "same  text", "Same Text"]
    ids = [*range(len(texts) - 2), None, 5]
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, texts, ids), keep="largest").collect()}
    norm = ["".join(c.lower() if c.isascii() else c for c in t or "") for t in texts]
    groups = defaultdict(list)
    for i, n in zip(ids, norm, strict=True):
        groups[n].append(i)
    for i, n in zip(ids, norm, strict=True):
        keep = max((x for x in groups[n] if x is not None), default=None)
        assert got[i, hashlib.sha256(n.encode()).hexdigest()] == (keep, len(groups[n]), i == keep)
    smallest = exact_dedup(frame(spark, ["x", "X", "y"], [3, 1, 2])).filter("kept").collect()
    assert sorted(r.doc_id for r in smallest) == [1, 2]
    assert exact_dedup(spark.createDataFrame([], NOTHING)).count() == 0


def test_the_index_merges_levels_and_answers_lookups(spark):
    index = Index(spark, shared_dir(spark), "smallest", fanout=2)
    want = defaultdict(list)
    for batch in range(5):
        ids = list(range(batch * 10, batch * 10 + 30))
        for i in ids:
            want[hashlib.sha256(str(i % 37).encode()).digest()].append(i)
        text = (F.col("id") % 37).cast("string")
        rows = spark.createDataFrame([(i,) for i in ids], "id long").select("id", sha256(text).alias("digest"), F.xxhash64(text).alias("hash"))
        assert index.ingest(rows).count() == 30
    assert [len(level) for level in index.levels] == [1, 0, 1]  # five batches, two by two
    some = hashlib.sha256(b"5").digest()
    assert sum(r.group_size for r in index.lookup(some).collect()) == len(want[some])
    got = {bytes(r.digest): (r.keep_id, r.group_size, r.low_hash == r.high_hash) for r in index.compact().collect()}
    assert got == {d: (min(ids), len(ids), True) for d, ids in want.items()}
    assert index.lookup(some).count() == 1


def test_the_filter_passes_what_it_holds_and_little_else(spark):
    held = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("hash"))
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("hash"))
    got = {r.id for r in passing(rows, filter_of(held)).collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1010
    assert passing(rows, filter_of(held.limit(0))).count() == 0


@pytest.mark.parametrize("weak", [lambda t: F.unhex(F.sha2(F.substring(t, 1, 1), 256)), lambda t: F.unhex(F.lit("00"))])
def test_texts_that_share_a_digest_are_told_apart_by_their_bytes(spark, weak):
    texts = ["ab", "ac", "AB", "b", None, "", "ac"]
    strong, weakly = (sorted(map(tuple, exact_dedup(frame(spark, texts), **how).drop("text_hash").collect())) for how in ({}, {"digest": weak}))
    assert strong == weakly and len(strong) == 7


def test_native_operators_run_no_python(spark):
    for out in (exact_dedup(frame(spark, ODD)), license_scan(frame(spark, ODD))):
        assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


def test_lower_case_is_that_of_ascii(spark):
    texts = [t for t in [*ODD, "ÀB İ ẞ", "AZ[a`z{"] if t is not None]
    got = frame(spark, texts).select("text", ascii_lower(F.col("text")).alias("l")).collect()
    assert all(r.l == "".join(c.lower() if c.isascii() else c for c in r.text) for r in got)


# Licences

def words_like_spark(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_licences(texts, every=False):
    """labels and score by trying every start at which a rare word of a template stands,
    or with ``every`` any word of it."""
    docs = [words_like_spark(t) for t in texts]
    split = [template_words(t.text) for t in TEMPLATES]
    vocabulary = {w for ws in split for w in ws} | {w for p in BASE_PHRASES for w in p.split()}
    idf = {w: math.log((len(docs) + 1) / (sum(w in d for d in docs) + 1)) + 1 for w in vocabulary}
    out, reach = [], 3 + max(map(len, split)) // 10
    for words in docs:
        labels, best = set(), 0.0
        for t, ws in zip(TEMPLATES, split, strict=True):
            total = sum(idf[w] for w in ws)
            for k, p in itertools.product(range(len(ws)) if every else rare_offsets(ws, idf), range(len(words))):
                if words[p] != ws[k]:
                    continue
                start, slack = p - k, lambda j, k=k: 3 + abs(j - k) // 10
                share = sum(idf[w] / total for j, w in enumerate(ws) if w in words[max(0, start + j - slack(j)) : max(0, start + j + slack(j) + 1)])
                stretch = f" {' '.join(words[max(0, start - reach) : max(0, start + len(ws) + reach)])} "
                best = max(best, share)
                if share >= 0.8 - 1e-9 and all(f" {' '.join(template_words(x))} " in stretch for x in t.key_phrases):
                    labels.add(t.label)
        base = {label for p, label in BASE_PHRASES.items() if f" {p} " in f" {' '.join(words)} "}
        out.append((",".join(sorted(labels | base)), 1.0 if base else min(best, 1.0) if best >= 0.5 - 1e-9 else 0.0))
    return out


def edited(text, share, rng):
    """A text with that share of its words replaced, left out or doubled."""
    out = []
    for w in text.split():
        if rng.random() >= share:
            out.append(w)
        elif (how := rng.randrange(3)) == 0:
            out.append("changed")
        elif how == 1:
            out += [w, w]
    return " ".join(out)


def test_license_scan(spark):
    rng = random.Random(26)
    texts = [*ODD, "Released under the MIT License. under the mit license", "Licensed under the Apache License, Version 2.0.", "CC-BY-NC and cc by nc", "licensed under GNU General Public License, version 3", "mit mit under the mit license2", *(prose(40) for _ in range(60))]
    texts += [f"{prose(30, rng)} {t.text} {prose(30, rng)}" for t in TEMPLATES] + [edited(t.text, 0.08, rng) for t in TEMPLATES] + [f"{TEMPLATES[1].text} and {TEMPLATES[9].text}", "hereby " * 50 + "granted warranty software", TEMPLATES[4].text.split("3. Neither")[0]]
    phrases = {tuple(p.split()): v for p, v in BASE_PHRASES.items()}
    got = {r.doc_id: r for r in license_scan(frame(spark, texts)).collect()}
    for i, (t, (labels, score)) in enumerate(zip(texts, brute_licences(texts), strict=True)):
        words = words_like_spark(t)
        hits = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(hits))
        assert (r.first_word, r.last_word) == ((min(k for k, _ in hits), max(k for k, _ in hits)) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert r.labels == labels and r.score == pytest.approx(score)
    assert "gpl-3" in got[len(ODD) + 3].labels
    for k, t in enumerate(TEMPLATES):
        assert t.label in got[len(ODD) + 65 + k].labels.split(",")
    assert license_scan(spark.createDataFrame([], NOTHING)).count() == 0
    twice = license_scan(frame(spark, ["released under the mit license"] * 2 + [None], [None, None, 1])).collect()
    assert sorted((r.doc_id is None, r.labels) for r in twice) == [(False, ""), (True, "mit"), (True, "mit")]


def test_rare_words_find_what_all_words_would(spark):
    rng = random.Random(31)
    short = [t for t in TEMPLATES if len(template_words(t.text)) < 120]
    texts = [f"{prose(20, rng)} {edited(t.text, share, rng)} {prose(20, rng)}" for share in (0.02, 0.05, 0.1) for t in short for _ in range(2)]
    want = [labels for labels, _ in brute_licences(texts, every=True)]
    got = {r.doc_id: r.labels for r in license_scan(frame(spark, texts)).collect()}
    both = sum(want[i] == got[i] != "" for i in range(len(texts)))
    assert all(set(got[i].split(",")) <= set(w.split(",")) for i, w in enumerate(want) if got[i])
    assert both >= 0.9 * sum(w != "" for w in want) > 20


def test_blocks_do_not_change_what_is_found(spark, monkeypatch):
    rng = random.Random(32)
    texts = [" ".join([prose(rng.randrange(200), rng), edited(t.text, 0.04, rng), prose(rng.randrange(300), rng), t.text]) for t in TEMPLATES] + ODD
    whole = [tuple(r) for r in license_scan(frame(spark, texts)).orderBy("doc_id").collect()]
    for words in (50, 333):
        monkeypatch.setattr(importlib.import_module("congruity.llm.license_scan"), "BLOCK", words)
        assert [tuple(r) for r in license_scan(frame(spark, texts)).orderBy("doc_id").collect()] == whole


def test_a_long_text_of_one_licence_word(spark):
    began = time.time()
    rows = {r.doc_id: r for r in license_scan(frame(spark, ["x", "hereby " * 700_000, "mit", TEMPLATES[0].text * 200, "y"])).collect()}
    assert rows[1].n_words == 700_000 and rows[1].labels == "" and rows[1].score == 0 and TEMPLATES[0].label in rows[3].labels
    assert time.time() - began < 60


def test_a_place_without_rare_words_cannot_reach_the_share():
    rng = random.Random(27)
    for t in TEMPLATES:
        ws = template_words(t.text)
        idf = {w: rng.choice([0.5, 1, 1, 4]) for w in ws}
        rare = rare_offsets(ws, idf)
        assert sum(idf[w] for k, w in enumerate(ws) if k not in set(rare)) < 0.8 * sum(idf[w] for w in ws)


# Tokens

def texts_for_tokens():
    letters = "aé東Σ '’sStT1½ \n\t\x1c\x85‍!?.<|>😀́ "
    rng = random.Random(1)
    return [*ODD, "It's we'll DON'T", "ΣΑΣ ΟΔΟΣ İx ﬁ", "１２３ ½²", *("".join(rng.choice(letters) for _ in range(60)) for _ in range(400)), *(prose(50) for _ in range(30))]


def test_bpe_gives_the_ids_and_texts_of_the_library(spark):
    texts = texts_for_tokens()
    library = Tokenizer.from_file(WORD_BPE)
    got = {r.doc_id: r for r in bpe_encode(frame(spark, texts), WORD_BPE).collect()}
    for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == e.ids and got[i].n_tokens == len(e.ids)
        assert got[i].decoded == library.decode(e.ids, skip_special_tokens=False)
    assert bpe_encode(spark.createDataFrame([], NOTHING), WORD_BPE).count() == 0


@pytest.mark.parametrize("form", ["ab?cd", "x?", "? a?\u0301"])
def test_every_code_point_gives_the_ids_of_the_library(form):
    own, library = Encoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 1024):
        text = " ".join(form.replace("?", chr(c)) for c in points[k : k + 1024])
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_pieces_are_not_remembered():
    own, files, library = Encoder(WORD_BPE), PieceEncoder(BYTE_BPE), Tokenizer.from_file(WORD_BPE)
    text = " ".join(["QUJD" * 400 + "==", "東京" * 300, "a.b" * 200, "ok"])
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    files.encode(text)
    for seen in (own.seen, files.seen, files.ends, files.words):
        assert max(map(len, seen), default=0) <= 64


def test_backtracking_is_linear_on_long_words():
    own = Encoder(WORD_BPE)
    library = Tokenizer.from_file(WORD_BPE)
    for word in ("ab" * 20_000, "aaaaaaa" * 3000, "".join(random.Random(2).choice("etaoin") for _ in range(20_000))):
        assert np.frombuffer(own.encode(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_token_files(spark):
    texts = texts_for_tokens()
    ids = [*range(100, 100 + len(texts) - 2), None, 100]
    path = shared_dir(spark)
    write_token_files(frame(spark, texts, ids).repartition(5), path, BYTE_BPE)
    library = Tokenizer.from_file(BYTE_BPE)
    encoded = [[*e.ids, 0] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = with_crc32(read_token_files(spark, path)).collect()
    want = Counter((i, len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for i, e in zip(ids, encoded, strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    plan = read_token_files(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in re.search("ReadSchema: [^\n]*", plan)[0]
    for name in sorted(p for p in os.listdir(path.removeprefix("file://")) if p.endswith(".parquet")):
        meta = pq.ParquetFile(f"{path.removeprefix('file://')}/{name}").metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert meta.row_group(g).total_byte_size <= 2 * int(FORMAT["parquet.block.size"])
            for c, column in columns.items():
                assert column.has_offset_index and column.has_column_index
                assert ("RLE_DICTIONARY" if c.startswith("ids") else "DELTA_BINARY_PACKED") in column.encodings, c
    same = shared_dir(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_token_files(frame(spark, ["one text"] * 3000 + ["x"] * 10, [7] * 3000 + list(range(10))).repartition(8), same, BYTE_BPE)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = Counter(r.part for r in spark.read.parquet(same).filter("doc_id = 7").select("part").collect())
    assert len(parts) > 1 and max(parts.values()) < 2500  # one id does not fill one task
    none = shared_dir(spark)
    write_token_files(spark.createDataFrame([], NOTHING), none, BYTE_BPE)
    assert with_crc32(read_token_files(spark, none)).count() == 0


def test_pieces_remembered_give_the_same_ids_again():
    own, library = PieceEncoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    texts = [x or "" for x in texts_for_tokens()] * 2
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(own.encode(t), "<i4").tolist() for t in texts] == want
    for some in (slice(0, None), slice(len(ODD) + 404, None), slice(0, 0), slice(1, 2)):  # mixed, plain, none, an empty text
        ids, n = own.encode_many(texts[some])
        assert ids.tolist() == [i for w in want[some] for i in w] and n.tolist() == [len(w) for w in want[some]]


ENDED = ["Prix :\xa05 €\r\nOui \r\nNon", "é \r\nb\xa0c", "é\r", "\ré", "é \r", "\u3000é \r b", "é\r\n\r\n x"]


def test_line_ends_and_other_spaces_of_texts_beyond_ascii():
    own, library, rng = PieceEncoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE), random.Random(9)
    letters = ["a", "é", "東", " ", " ", "\n", "\r", "\r\n", "\xa0", "\u3000", "\t", "\x1c", "\x85", "'s", ".", "1", "\u2028", "\u180e", "\u200b"]
    texts = ENDED + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(30_000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids, n = own.encode_many(texts)
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("form", ["ab?cd ?'s", " ? x?\r\n?"])
def test_every_code_point_of_a_text_file_gives_the_ids_of_the_library(form):
    own, library = PieceEncoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for kind in (COMMON, SPACE, UNKNOWN):
        some = [c for c in points if kinds()[c] == kind]
        texts = [" | ".join(form.replace("?", chr(c)) for c in some[k : k + 256]) for k in range(0, len(some), 256)]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        ids, n = own.encode_many(texts)
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


# Chats

def test_escapes_are_undone(spark):
    rng = random.Random(4)
    pieces = ["<", "</", "s>", "[", "/", "INST]", "\\", "</s>", "[INST]", "[/INST]", "<s>", "x", "\n", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(8)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r.t == r.u and not any(m in r.e for m in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_chat_windows(spark):
    rng = random.Random(5)
    rows = []
    for c in range(12):
        rows += [(c, k, "system" if k == 0 and c % 2 else rng.choice(["user", "assistant"]), rng.choice(["", None, "</s>[INST] ok [/INST]", "é" * 50, prose(rng.randrange(120), rng)])) for k in range(rng.randrange(1, 30))]
    rows += [(None, 0, None, "x"), (None, None, "assistant", "y"), (99, 0, "assistant", "z " * 4000), (99, 1, "user", "w")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    path = shared_dir(spark)
    format_chats(df, budget=256, history=48).write.parquet(path)
    got = {r.conv_id: r for r in read_back(spark, path).collect()}
    by = defaultdict(list)
    for c, k, role, text in rows:
        by[c].append((k is not None, k or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort(key=lambda t: t[:3])
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    windows = read_turns(spark.read.parquet(path)).collect()
    for w in windows:
        assert any(not t.repeated for t in w.turns)
        if w.window_id and w.conv_id is not None and w.conv_id < 12 and w.conv_id % 2:
            assert w.turns[0].role == "system" and not w.turns[0].loss
    text = spark.read.parquet(path).filter("conv_id = 3").collect()
    for w in text:
        for t in w.turns:
            assert w.formatted[t.start + t.length :].startswith("</s>")
    assert format_chats(df.limit(0)).count() == 0


def test_windows_keep_to_the_budget_and_repeat_no_more_than_the_history(spark):
    rng, budget, history = random.Random(29), 400, 60
    tokens = lambda text: -(-len(text.encode()) // 4) + 4
    rows = [(c, k, "system" if k == 0 and c % 2 else rng.choice(["user", "assistant"]), "é" * rng.randrange(1, 60) if k == 0 else prose(rng.randrange(12), rng)) for c in range(30) for k in range(rng.randrange(1, 80))]
    limit = budget // 2 - history - max(tokens(t) for _, _, r, t in rows if r == "system")
    assert max(tokens(t) for *_, t in rows) <= limit  # else a window holds a long turn whole
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = read_turns(format_chats(df, budget, history)).collect()
    repeated = 0
    for w in windows:
        assert sum(tokens(t.text) for t in w.turns) <= budget
        again = sum(tokens(t.text) for t in w.turns if t.repeated and t.role != "system")
        assert again <= history and not any(t.loss for t in w.turns if t.repeated)
        repeated += again > 0
    assert repeated > 20 and max(w.window_id for w in windows) > 3
    want = Counter((c, r, t) for c, _, r, t in rows)
    assert Counter((w.conv_id, t.role, t.text) for w in windows for t in w.turns if not t.repeated) == want


# Pages

def test_main_text(spark):
    page = "<html><head><title>T</title></head><body class='single-post'><nav>Menu</nav><header>Head</header><div id=cookie-notice>We use</div><article><h1>A&amp;B</h1><p>One\n <b>tw</b>o&nbsp;3<script>var a='</p>';</script><!-- x --><div class='comments'>No <div>deep</div> no</div><p>Last &lt;</article><aside>Side</aside><footer>Foot"
    assert main_text(runs(page)) == "A&B One two 3 Last <"
    assert main_text(runs("<article><p title='5\" tall' x=\"a>b\">one</p><p y\">two</p><a href=\"open>three</article>")) == "one two three"
    plain = ["<body><div>Home About Contact Login Search Help More Links Here</div><p>%s</p></body>" % t for t in ("first page words here", "second text of the host", "third")]
    pages = [(i, f"http://h.org/{i}", p) for i, p in enumerate([page, None, "", "<", "<article>", "no tags at all & more"])]
    pages += [(10 + i, f"http://same.org/{i}", p) for i, p in enumerate(plain)] + [(20, "http://other.org/", plain[0]), (20, "http://other.org/", plain[0]), (None, None, "<main>m</main>")]
    df = spark.createDataFrame([(*p, 7, "x") for p in pages], "page_id long, url string, html string, page int, text string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_text(df).collect())
    want = Counter({(0, "A&B One two 3 Last <", 20): 1, (1, "", 0): 1, (2, "", 0): 1, (3, "<", 1): 1, (4, "", 0): 1, (5, "no tags at all & more", 21): 1, (None, "m", 1): 1})
    want += Counter({(10, "first page words here", 21): 1, (11, "second text of the host", 23): 1, (12, "third", 5): 1})
    alone = "Home About Contact Login Search Help More Links Here first page words here"
    want[20, alone, len(alone)] = 2
    assert got == want
    assert html_text(df.limit(0)).count() == 0


def test_main_text_in_wrappers():
    article = "<article class='post tag-advertising category-search ad'>text<div class='comments'>no<article>no</article></div></article>"
    wrappers = ["<div class='content with-sidebar'>", "<div class='has-comments no-ads'>", "<form id=aspnetForm>", "<div class=widget>", "<form><div class='header fixed'>"]
    for w in ["", *wrappers]:
        assert main_text(runs(f"<body>{w}<div class=cookie-notice>we</div>{article}")) == "text"
        assert main_text(runs(f"<body>{w}<nav><article>no</article></nav><div class=comments><article>no</article></div>{article}")) == "text"
    assert main_text(runs("<main>a<div class='social-share'>no</div><div id=ad-3>no</div><p class=shared-history>b</main>")) == "a b"
    assert main_text(runs("<div class=main-nav>no</div><div class=main-content>a</div>")) == "a"


def test_main_text_of_unusual_pages():
    for page in (
        "<html><head><title>T</title><meta charset=utf-8><body><article>text</article>",
        "<html><head><title>T</title><article>text</article>",
        "<div class='content no-sidebar'><article>text</article></div>",
        "<article class='post has-sidebar'>text</article>",
        "<form><nav>menu</nav><article>text</article></form>",
        "<article><p class='share-price' id='search-for-life'>text</p></article>",
        "<head><script>var a = '<article>no</article>'</script></head><main>text</main>",
        "<article>text<footer>by</footer></article></nav></div></article>",
        "<article><nav>a<nav>b</nav>c</nav>text</article><footer>f<article>no</article></footer>",
    ):
        assert main_text(runs(page)) == "text", page
    deep = "<nav>" * 30_000 + "no" + "</nav>" * 30_000 + "<div>" * 30_000 + "<article>" * 20_000 + "text"
    began = time.perf_counter()
    assert main_text(runs(deep)) == "text" and main_text(runs("<article>" + "word " * 400_000 + "<svg>" * 5000)) == ("word " * 400_000).strip()
    assert time.perf_counter() - began < 20


def test_repeats_of_a_host_decide_on_pages_without_an_article(spark):
    rng = random.Random(28)
    lines, main = [prose(rng.randrange(3, 20), rng) for _ in range(6)], "main " * 300 + "text"  # more than the rest
    pages = []
    for i in range(40):
        own = [prose(rng.randrange(1, 30), rng, 9000) for _ in range(3)]
        parts = [f"<div>{t}</div>" for t in rng.sample(lines, 3) + own] + [f"<nav>{rng.choice(lines)}</nav>", "<form>" + rng.choice(lines) + "</form>"]
        rng.shuffle(parts)
        pages.append((i, f"http://h{i % 3}.org/{i}", "<body>" + "".join(parts) + (f"<article>{main}</article>" if i % 8 == 0 else "")))
    pages += [pages[3], (100, "http://h0.org/x", "<body>" + lines[0])]
    streams = {i: [(k, t.split()) for k, t in runs(h) if t] for i, _, h in pages}
    heads = defaultdict(set)
    host = {i: u.split("/")[2] for i, u, _ in pages}
    whole = lambda w: [tuple(w[k : k + 8]) for k in range(len(w) - 7)] or [(*w, None)]
    for i, found in streams.items():
        for k, w in found:
            if k != 0:  # protected
                for part in whole(w):
                    heads[host[i], part].add(i)
    want = Counter()
    for i, _, h in pages:
        if main_text(runs(h)) is not None:
            want[i, main, True] += 1
            continue
        out = []
        for k, w in streams[i]:
            if k == 1:  # open
                gone = {j + d for j, part in enumerate(whole(w)) if len(heads[host[i], part]) > 1 for d in range(min(8, len(w)))}
                out += [x for j, x in enumerate(w) if j not in gone]
        want[i, " ".join(out), False] += 1
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert Counter((r.page_id, r.text, r.from_structure) for r in html_text(df).collect()) == want
    assert len({t for _, t, s in want if not s}) > 20


def test_neighbours_in_the_suffix_array(spark):
    """One line of a large host is split between tasks; what repeats is the same."""
    rng = random.Random(29)
    rows = [("h", "line", 7, k if k % 3 else None, 0, k, 8) for k in range(3000)] + [("h", "twice", p, p, 0, 0, 8) for p in (1, 2)]
    rows += [(f"h{rng.randrange(3)}", f"s{rng.randrange(60)}", rng.randrange(3), k if k % 2 else None, 1, k, 8) for k in range(300)]
    for more in ([], [("h", "line", 8, None, 0, 0, 8)]):
        entries = spark.createDataFrame(rows + more, "host string, suffix string, page bigint, key bigint, run int, start int, n int")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            array = suffix_array(entries)
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        sizes = [r["count"] for r in array.groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == len(rows + more) and len(sizes) > 3 and max(sizes) < 0.6 * sum(sizes)
        pages = defaultdict(set)
        for h, suffix, page, *_ in rows + more:
            pages[h, suffix].add(page)
        found = [tuple(r) for r in repeats_of(array).collect()]
        assert len(found) == len(set(found)) and set(found) == {x for x, on in pages.items() if len(on) > 1}
    kinds = (pa.string(), pa.string(), *[pa.int64()] * 2, *[pa.int32()] * 3)
    sort = sorted([("h", s, p, 0, 0, 0, 8) for s, p in (("a", 1), ("a", 1), ("a", 2), ("b", 2), ("b", 3))])
    table = pa.table({c: pa.array(x, t) for c, x, t in zip(ENTRIES, zip(*sort, strict=True), kinds, strict=True)})
    for size in (1, 2, 5):
        got = pa.Table.from_batches(neighbours(iter(table.to_batches(max_chunksize=size))))
        assert got["differs"].to_pylist() == [False, False, True, False, True] and got["edge"].to_pylist() == [True, False, False, False, True]


# Suffix dedup

def brute_suffix(texts, n):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append((int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("group", [20_000, 2])
def test_suffix_dedup(spark, monkeypatch, group):
    monkeypatch.setattr("congruity.llm.suffix_dedup.GROUP", group)
    monkeypatch.setattr("congruity.llm.suffix_dedup.SEGMENT", 1500)
    rng = random.Random(6)
    shared, texts = [prose(90, rng) for _ in range(4)], list(ODD)
    for _ in range(40):
        texts.append(" ".join(rng.choice([prose(rng.randrange(30), rng), rng.choice(shared), rng.choice(shared)[rng.randrange(90) :]]) for _ in range(4)))
    texts += [texts[20], texts[20], "xy" * 700, "y" + "xy" * 500, shared[0][:400], shared[0][1:401], shared[1][:399]]
    ids = [*range(len(texts) - 1), None]
    got = {r.doc_id: r for r in suffix_dedup(frame(spark, texts, ids)).collect()}
    data = [(t or "").encode() for t in texts]
    for i, t, (n, kept) in zip(ids, data, brute_suffix(data, 400), strict=True):
        assert (got[i].n_bytes, len(got[i].spans), bytes(got[i].kept)) == (len(t), n, kept)
    assert suffix_dedup(spark.createDataFrame([], NOTHING)).count() == 0


@pytest.mark.parametrize("segment", [1, 337, 1500, 4096])
def test_suffix_sample_is_the_same_in_segments(segment):
    text = np.random.default_rng(12).integers(0, 256, 20_000, np.uint8).tobytes() + b"xy" * 700
    whole, parts = sample(text, 400), sample(text, 400, segment)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    assert len(np.unique(parts[0])) == len(parts[0])


def test_suffix_dedup_keeps_long_unique_texts(spark):
    text = np.random.default_rng(13).integers(97, 123, 2 * SEGMENT + 5000, np.uint8).tobytes().decode()
    twice = text[SEGMENT - 300 : SEGMENT + 300]
    got = {r.doc_id: r for r in suffix_dedup(frame(spark, [text, text[:1000][::-1], "." + twice])).collect()}
    assert [tuple(s) for s in got[0].spans] == [(SEGMENT - 300, SEGMENT + 300)] and bytes(got[2].kept) == b"."
    assert got[1].spans == [] and len(got[1].kept) == 1000


@pytest.mark.parametrize("group", [20_000, 1])
def test_suffix_dedup_compares_bytes_where_hashes_collide(spark, monkeypatch, group):
    monkeypatch.setattr("congruity.llm.suffix_dedup.GROUP", group)
    word = [bin(k).count("1") % 2 for k in range(256)]  # its complement has the same hash modulo 2^64
    t, u = ("".join("/K"[x ^ flip] for x in word) for flip in (0, 1))
    rng = random.Random(21)
    texts = []
    for size in (192, 160, 128, 96):
        gap = "".join(rng.choice("abcdefghij") for _ in range(size))
        texts += [t + gap + u, u + gap + t]
    texts += [prose(30, rng) + t + gap + u + prose(30, rng), "x" + texts[0]]
    got = {r.doc_id: r for r in suffix_dedup(frame(spark, texts)).collect()}
    data = [x.encode() for x in texts]
    for i, (x, (n, kept)) in enumerate(zip(data, brute_suffix(data, 400), strict=True)):
        assert (got[i].n_bytes, len(got[i].spans), bytes(got[i].kept)) == (len(x), n, kept)
    assert [len(got[i].spans) for i in range(10)] == [1, 0, 0, 0, 0, 0, 1, 0, 1, 1]


def test_suffix_groups_settle_by_bytes_even_if_all_hashes_are_equal(monkeypatch):
    rng = random.Random(22)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(30, 90))) for _ in range(6)]
    blobs, lefts = [], []
    for _ in range(40):
        before, after = rng.choice(parts) + rng.choice(parts), rng.choice(parts) + rng.choice(parts)
        before, after = before[-rng.randrange(1, 60) :], after[: rng.randrange(20, 90)]
        blobs.append((before + "c" * 64 + after).encode())
        lefts.append(len(before))
    length = 124
    w = length - 64 + 1
    blobs = [b[max(0, n - w + 1) : n + length] for b, n in zip(blobs, lefts, strict=True)]
    lefts = [min(n, w - 1) for n in lefts]
    group = pa.table({"core": [1] * 40, "around": [bytes([i]) for i in range(40)], "n": [1] * 40, "left": pa.array(lefts, pa.int32()), "bytes": blobs})
    right = solve(group, length)["spans"].to_pylist()
    want = []
    for i in range(40):
        gone = np.zeros(w, bool)
        for d in range(lefts[i] + 1):
            own = blobs[i][lefts[i] - d : lefts[i] - d + length]
            gone[d] = len(own) == length and any(j != i and lefts[j] >= d and blobs[j][lefts[j] - d : lefts[j] - d + length] == own for j in range(40))
        want.append(intervals(gone, length))
    assert right == want and any(want)
    names = suffix_module.window_names
    monkeypatch.setattr(suffix_module, "window_names", lambda *a: np.minimum(names(*a), np.uint64(1 << 40)))  # only fillers are smaller
    assert solve(group, length)["spans"].to_pylist() == want


def test_suffix_groups_of_many_cores_are_settled_together():
    """Also where a core's rows lie in several batches."""
    rng, rows = random.Random(23), []
    for core in range(30):
        parts = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(3)]
        for k in range(rng.randrange(1, 9)):
            before, after = rng.choice(parts)[rng.randrange(60) :], rng.choice(parts)[: rng.randrange(20, 60)]
            rows.append((core, 100 * core + k, rng.choice([1, 1, 2]), len(before), before + bytes([core] * 64) + after))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    table = pa.table({n: pa.array(x, t) for n, x, t in zip(("core", "around", "n", "left", "bytes"), zip(*rows, strict=True), kinds, strict=True)})
    want = [x for core in range(30) for x in solve(table.filter(pa.compute.equal(table["core"], core)), 124)["spans"].to_pylist()]
    blocks = list(suffix_module.whole_cores(iter(table.to_batches(max_chunksize=7)), 10))
    assert all(set(a["core"].to_pylist()).isdisjoint(b["core"].to_pylist()) for a, b in itertools.combinations(blocks, 2))
    assert len(blocks) > 5 and [x for b in blocks for x in solve(b, 124)["spans"].to_pylist()] == want and any(want)


# Jaccard join

def brute_links(texts):
    sets = [set(shingles(t or "").tolist()) for t in texts]
    links, root = [0] * len(texts), list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if (not a and not b) or a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
            links[i] += 1
            links[j] += 1
            x, y = sorted((root[i], root[j]))
            root = [x if r == y else r for r in root]
    return links, root


@pytest.mark.parametrize("block", [500, 5])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr("congruity.llm.jaccard_join.BLOCK_SETS", block)
    rng = random.Random(8)
    texts = list(ODD)
    for _ in range(6):
        base = prose(rng.choice([6, 60, 200]), rng, 5000).split()
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += [texts[-1], texts[-1].upper(), "five words are not here", "only four words here"]
    links, root = brute_links(texts)
    got = {r.doc_id: r for r in jaccard_join(frame(spark, texts)).collect()}
    for i in range(len(texts)):
        assert (got[i].class_id, got[i].n_links, got[i].group_size) == (root[i], links[i], root.count(root[i]))
    assert sum(r.stays for r in got.values()) == len(set(root))
    odd = jaccard_join(frame(spark, ["x y", "x y", "z", "q"], [None, 4, None, 4])).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in odd) == Counter([(None, 4, 1), (4, 4, 1), (None, None, 0), (4, 4, 0)])
    assert jaccard_join(spark.createDataFrame([], NOTHING)).count() == 0


def test_prefixes_are_shortened_until_the_target(spark, monkeypatch):
    depths, real = [], jaccard_module.compare_at
    monkeypatch.setattr(jaccard_module, "compare_at", lambda depth, *a: depths.append(depth) or real(depth, *a))
    rng = random.Random(23)
    base = prose(400, rng, 9000).split()
    near = frame(spark, [" ".join([*base[:-1], str(k)]) for k in range(8)])  # links of similarity 0.99
    assert all(r.n_links == 7 for r in jaccard_join(near).collect()) and depths == [5]
    far = frame(spark, [" ".join([*base[:200], *(f"{k}-{j}" for j in range(21)), *base[221:]]) for k in range(3)])  # and of 0.88
    depths.clear()
    jaccard_join(far, threshold=0.5, target=1.0).collect()
    assert depths == [5, 4, 3, 2, 1]
    assert expected_recall(np.array([0, 0, 5]), 0.8, 20, 5) > 0.9999 > expected_recall(np.array([5, 0, 0]), 0.8, 20, 5)
    assert expected_recall(np.zeros(3), 0.8, 20, 4) == recall(0.8, 20, 4) >= 0.9999 > recall(0.8, 20, 5)


@pytest.mark.parametrize("n", [6, 60])
def test_every_pair_is_met_once(n):
    rng = np.random.default_rng(24)
    sig = rng.integers(0, 3, (n, TREES, DEPTH)).astype(np.uint32)
    same = np.logical_and.accumulate(sig[:, None] == sig[None], axis=3)
    times = sum(first_met(sig, sig, t, d).astype(int) for d in range(1, DEPTH + 1) for t in range(TREES))
    assert (times == same[..., 0].any(axis=2)).all()
    for d in range(1, DEPTH + 1):
        upto = sum(first_met(sig, sig, t, k).astype(int) for k in range(d, DEPTH + 1) for t in range(TREES))
        assert (upto == same[..., d - 1].any(axis=2)).all()


def test_signatures_are_read_as_they_were_written():
    some = signature(shingles("one two three four five six seven"))
    assert len(some) == TREES * DEPTH * 4 and read_signatures(pa.chunked_array([pa.array([some])])).astype(">u4").tobytes() == some


def test_recall_of_links(spark):
    rng = random.Random(25)
    texts = []
    for _ in range(60):
        base = prose(200, rng, 20_000).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(200)] = prose(1, rng, 20_000)
            texts.append(" ".join(copy))
    links, root = brute_links(texts)
    got = {r.doc_id: r for r in jaccard_join(frame(spark, texts)).collect()}
    assert sum(got[i].n_links for i in got) >= 0.999 * sum(links) and all(got[i].n_links <= n for i, n in enumerate(links))
    assert sum(got[i].class_id != r for i, r in enumerate(root)) <= 2


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {v: r for v, r in root.items() if v != r}


# Quality

def test_quality_learns_and_keeps_clean_texts(spark):
    rng = random.Random(10)
    texts, marks = [], []
    for k in range(600):
        bad = k % 4 == 0
        words = prose(rng.randrange(20, 200), rng).split()
        texts.append(" ".join(w.upper() + "!!$$$" if bad else w for w in words))
        marks.append(int(not bad))
    docs = frame(spark, [*texts, *ODD])
    labels = spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)] + [(None, 1, 0), (3, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == len(texts) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(600))
    assert sum(got[i].predicted == marks[i] for i in held) >= 0.97 * len(held)
    assert all(got[i].predicted for i in held if marks[i])
    twice = labels.filter("quality = 1").unionByName(labels.withColumn("quality", F.lit(0)))
    assert quality.fit(docs, twice) == quality.fit(docs, labels.withColumn("quality", F.lit(0)))
    nothing = quality.quality(docs, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_quality_fits_where_texts_are_long_or_repeat(spark, caplog):
    rng = random.Random(14)
    marks = [int(k % 2 == 0) for k in range(80)]
    texts = [" ".join(w if m else w.upper() + "!!$$$" for w in prose(600, rng).split()) for m in marks]
    ids = list(range(80))
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, quality int")
    model = quality.fit(frame(spark, texts, ids), labels, sample_bytes=6000)  # less than two texts
    assert model.good and model.bad and any(model.weights[1:])
    own = quality.Scorer(model.good, model.bad, model.weights)
    assert sum((own.score(t) >= 0.5) == m for t, m in zip(texts, marks, strict=True)) >= 76
    again = quality.fit(frame(spark, texts + texts[:1] * 50 + texts[1:2] * 50, ids + [0] * 50 + [1] * 50), labels, sample_bytes=6000)
    assert again == model
    caplog.clear()
    assert not quality.fit(frame(spark, texts[:4]), labels).good and "every text gets the score" in caplog.text
    assert quality.allotment([5, 1, 9], 100) == 9 and quality.allotment([5, 1, 9], 9) == 4 and quality.allotment([], 5) == 0
    assert sum(map(len, quality.spread(b"a" * 5000, 2500))) <= 2500 and b"".join(quality.spread(b"ab" * 900, 1800)) == b"ab" * 900


# Decontamination

def brute_align(item, words):
    h = np.zeros((len(item) + 1, len(words) + 1), int)
    for i in range(len(item)):
        for j in range(len(words)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if item[i] == words[j] and item[i] > 0 else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(11)
    for _ in range(60):
        item, words = rng.integers(1, 5, rng.integers(1, 14)), rng.integers(0, 5, rng.integers(1, 30))
        points, a, b = align(item, words)
        assert points == brute_align(item, words)
        if points:
            assert brute_align(item, words[a : b + 1]) == points


def test_decontamination(spark):
    rng = random.Random(12)
    items = [prose(n, rng, 3000) for n in (40, 30, 25, 3, 2)]
    edited = items[0].split()
    for k in range(3, 40, 9):
        edited[k] = "changed"
    texts = [*ODD, *(prose(300, rng, 3000) for _ in range(20)), f"Start {items[1].upper()}, end", prose(50, rng) + " " + " ".join(edited) + " " + prose(50, rng), items[2] + " " + items[0], "x " + items[3] + " y"]
    at = len(texts) - 4
    bench = spark.createDataFrame([*((i, t, 1) for i, t in enumerate(items)), (7, None, 1), (8, "", 1), (0, items[0], 1)], "item_id long, text string, doc_id int")
    found = decontaminate(frame(spark, texts), bench).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    assert {(at, 1), (at + 1, 0), (at + 2, 2), (at + 2, 0), (at + 3, 3)} <= set(got) and len(got) == len(found)
    assert got[at, 1].score == 1 and (got[at, 1].first_word, got[at, 1].last_word) == (1, 30)
    assert 0.5 <= got[at + 1, 0].score < 1
    assert not [k for k in got if k[1] in (0, 1, 2) and k[0] < at]
    blocks = {(r.doc_id, r.item_id, r.score) for r in decontaminate(frame(spark, texts), bench, block_words=30).collect()}
    assert blocks == {(r.doc_id, r.item_id, r.score) for r in found}
    sizes = [sum(len(re.findall(r"\w+", t)) for _, t in b) for b in items_in_blocks(bench.repartition(3), "item_id", "text", 60)]
    assert sizes == [40, 60] and [len(b) for b in items_in_blocks(bench, "item_id", "text", 1)] == [1] * 5
    assert decontaminate(frame(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate(spark.createDataFrame([], NOTHING), bench).count() == 0
    assert MATCH > 0


def test_edited_items_are_found_as_by_aligning_everything(spark):
    rng = random.Random(30)
    items = [prose(rng.choice([15, 20, 30, 60]), rng, 4000) for _ in range(40)]
    texts, shares = [], []
    for share in (0, 0.05, 0.1, 0.15, 0.2):
        for i in range(40):
            words = []
            for w in items[i].split():
                if rng.random() >= share:
                    words.append(w)
                elif (how := rng.randrange(3)) == 0:
                    words.append(prose(1, rng, 4000))
                elif how == 1:
                    words += [w, prose(1, rng, 4000)]
            texts.append(" ".join([prose(rng.randrange(1, 60), rng, 4000), *words, prose(rng.randrange(1, 60), rng, 4000)]))
            shares.append(share)
    texts += [prose(150, rng, 4000) for _ in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate(frame(spark, texts), bench).collect()}
    numbers = {w: n + 1 for n, w in enumerate(sorted({w for t in [*texts, *items] for w in re.findall(r"\w+", t.lower())}))}
    coded = [np.array([numbers[w] for w in re.findall(r"\w+", t.lower())]) for t in [*texts, *items]]
    want = {}
    for d in range(len(texts)):
        for i in range(40):
            points = align(coded[len(texts) + i], coded[d])[0] / (2 * len(coded[len(texts) + i]))
            if points >= 0.5:
                want[d, i] = points
    assert set(got) <= set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    for share, least in ((0, 1), (0.05, 1), (0.1, 1), (0.15, 0.97), (0.2, 0.92)):
        hits = [k for k in want if k[0] < 200 and shares[k[0]] == share]
        print("share of edited words", share, "found", sum(k in got for k in hits), "of", len(hits))
        assert len(hits) > 25 and sum(k in got for k in hits) >= least * len(hits)


def test_registered_queries_are_named_by_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


# Pages that structure alone does not settle

def test_articles_that_are_teasers_or_comments(spark):
    words = lambda n, of: " ".join(f"{of}{k}" for k in range(n))
    menu = f"<div>{words(12, 'menu')}</div>"
    story = f'{menu}<div class="story">{words(60, "own")}</div><article class="card">{words(6, "teaser")}</article>'
    other = f'{menu}<div class="story">{words(60, "else")}</div><article class="card">{words(6, "teaser")}</article>'
    copy = f"{menu}<p>{words(30, 'copied')}</p>"
    rows = [(1, "http://a.b/1", story), (2, "http://a.b/2", other), (3, "http://a.b/x", copy), (4, "http://a.b/x?print=1", copy)]
    got = {r.page_id: r.text for r in html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: words(60, "own"), 2: words(60, "else"), 3: words(30, "copied"), 4: words(30, "copied")}


def test_names_that_say_what_an_element_is():
    for name in ("ad-slot", "ad-container", "related-posts", "share-buttons", "comments-area", "user-comments"):
        assert main_text(runs(f'<article>a<div class="{name}">no</div>b</article>')) == "a b", name
    assert main_text(runs('<article>a<div id="cookie-bar">no</div>b</article>')) == "a b"
    for kept in ('<h2 id="promotion">yes</h2>', '<p id="menu">yes</p>', '<h1 class="banner">yes</h1>', '<div class="with-sidebar">yes</div>', '<p class="shared-history">yes</p>'):
        assert main_text(runs(f"<article>a{kept}b</article>")) == "a yes b", kept
    assert main_text(runs('<article>a text</article><section class="user-comments"><article class="comment-body">no</article></section><article class="comment">no</article>')) == "a text"
