"""Collocations, hard negatives and repeated word sequences against brute force."""

import hashlib
import importlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from congruity.llm.collocations import collocations, normalised
from congruity.llm.hard_negatives import Tree, hard_negatives, score_bounds
from congruity.llm.recompression import Windows, follow, settled, substring_dedup, window_symbols
from congruity.llm.word_names import LONG_WORD, word_names

collocation_module, recompression_module = (importlib.import_module(f"congruity.llm.{n}") for n in ("collocations", "recompression"))
DOCS = "doc_id long, text string, lang string, phrase string, name long, n long"
ODD = [None, "", " ", "\n\t", "A", "É é", "x" * 9000, ("y" * 5000 + " ") * 3, "ab " * 700, "a b \x1c c\x0bd", "., ;:", "😀 \u0000 y"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# Names of words

def test_equal_words_have_equal_names_wherever_they_stand():
    words = [b"a", b"b", b"ab", b"ba", b"a", b"z" * (LONG_WORD + 1), b"z" * (LONG_WORD + 2), "é".encode(), b"z" * (LONG_WORD + 1), b"\x00", b"\x00\x00"] * 3
    names, start, end = word_names(b" " + b" ".join(words) + b" ", 5)
    assert len({(w, n) for w, n in zip(words, names.tolist(), strict=True)}) == len(set(words)) == len(set(names.tolist()))
    assert [len(w) for w in words] == (end - start).tolist()
    assert names.tolist() != word_names(b" " + b" ".join(words) + b" ", 6)[0].tolist()


def test_portions_do_not_change_names(monkeypatch):
    data = b" " + b" ".join(b"%d" % (k * k) for k in range(3000)) + b" "
    whole = word_names(data, 1)[0]
    monkeypatch.setattr(importlib.import_module("congruity.llm.word_names"), "PORTION", 64)
    assert (word_names(data, 1)[0] == whole).all()


# Collocations

def brute_collocations(rows, least, top=2000, longest=3, percent=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + k] for q, c in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * c >= percent * counts[q[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def some_texts(rng, n):
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "New", "York", "Is", "a b"]
    return ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ? "]) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("bits", [20, 6])  # a sketch of 64 cells adds candidates in vain
def test_collocations_equal_brute_force(spark, bits):
    rng = random.Random(bits)
    rows = [(t, rng.choice(["en", "fr", None, "und"])) for t in ODD + some_texts(rng, 150)]
    docs = spark.createDataFrame([(None, t, g, "x", 1, 2) for t, g in rows], DOCS)
    got = sorted(tuple(r) for r in collocations(docs, least=4, cell_bits=bits).collect())
    assert got == brute_collocations(rows, 4) and len(got) > 50
    best = sorted(tuple(r) for r in collocations(docs, least=4, top=3, cell_bits=bits).collect())
    assert best == brute_collocations(rows, 4, top=3)


def test_collocations_of_longer_phrases(spark):
    rows = [("a b c d. " * 7 + "a b c. b c d x. " * 3, "en")]
    docs = spark.createDataFrame([(0, *rows[0], "", 0, 0)], DOCS)
    assert sorted(map(tuple, collocations(docs, least=3, longest=4, cell_bits=16).collect())) == brute_collocations(rows, 3, longest=4)


def test_collocations_in_blocks_and_portions(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(t, rng.choice(["en", "fr", "de"])) for t in some_texts(rng, 90)]
    docs = spark.createDataFrame([(0, *r, "", 0, 0) for r in rows], DOCS)
    for name, value in (("BLOCK", 25), ("PORTION", 50), ("HELD", 40), ("REMEMBERED", 8), ("ROW", 7)):
        monkeypatch.setattr(collocation_module, name, value)
    assert sorted(map(tuple, collocations(docs, least=3, cell_bits=12).collect())) == brute_collocations(rows, 3)


def test_texts_are_read_as_often_for_many_phrases_as_for_few(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(0, t, rng.choice(["en", "fr", "de"]), "", 0, 0) for t in some_texts(rng, 90)]
    for name, value in (("BLOCK", 25), ("PORTION", 50), ("REMEMBERED", 8)):
        monkeypatch.setattr(collocation_module, name, value)
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), DOCS)
    assert len(collocations(docs, least=3, cell_bits=12).collect()) > 100
    assert read.value == 3 * len(rows)  # their size, the sketch, the counts


def test_no_collocations(spark):
    assert collocations(spark.createDataFrame([], DOCS), cell_bits=8).collect() == []
    assert collocations(spark.createDataFrame([(1, "a b a b", "en", "", 0, 0)], DOCS), cell_bits=8).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [("q r. " * 70_000 + "q. r. q.", "en")]
    docs = spark.createDataFrame([(0, *rows[0], "", 0, 0)], DOCS)
    assert sorted(map(tuple, collocations(docs, cell_bits=16).collect())) == brute_collocations(rows, 10)  # 70000 ** 4 * 10 ** 6 > 2 ** 63


def test_normalised_texts():
    assert normalised("Ab\t c.D".encode()) == b" ab c \n d "
    assert normalised(b"") == b" "


# Hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, id long, vector string, hash long"


def brute_negatives(rows, positives=5, negatives=5):
    part = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        part.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    nulls_last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, label) in enumerate(part):
        if i is None or i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), nulls_last(j), j, g) for b, (j, w, g) in enumerate(part) if b != a)
        for p, _, j, _ in [s for s in scored if s[3] == label][:positives]:
            found = [s for s in scored if s[3] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, _, k, _) in enumerate(found)]
    return sorted(out, key=repr)


def some_vectors(rng, n, width, labels=3):
    centres = rng.normal(size=(6, width))
    rows = []
    for k in range(n):
        v = centres[k % 6] + rng.normal(size=width) * rng.choice([0.01, 0.4])
        rows.append((k, (v / np.linalg.norm(v)).tolist(), int(rng.integers(labels))))
    return rows


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)
    return sorted((tuple(r) for r in hard_negatives(frame, **more).collect()), key=repr)


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = some_vectors(rng, 450, 6)
    odd = [(500, [1.0, 2.0], 1), (501, [], 2), (502, None, 1), (503, [1.0, None], 1), (504, [math.nan], 1), (505, [math.inf], 2), (506, [1.0], None), (None, rows[3][1], 1), (None, rows[3][1], 0)]
    rows += odd + [rows[100], rows[100], rows[7]] + [(600 + k, rows[200][1], k % 3) for k in range(40)]
    got = mined(spark, rows)
    assert got == brute_negatives(rows) and len(got) > 50


def test_hard_negatives_in_small_blocks(spark, monkeypatch):
    own = importlib.import_module("congruity.llm.hard_negatives")
    for name, value in (("SAMPLE", 50), ("DEPTH", 3), ("ROWS", 20), ("ANCHORS", 2), ("FIRST", 1)):
        monkeypatch.setattr(own, name, value)
    rows = some_vectors(np.random.default_rng(5), 700, 4)
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, rows, positives=2, negatives=3) == brute_negatives(rows, 2, 3)


def test_hard_negatives_of_large_and_no_numbers(spark):
    big = [(100 * k, [1e30 * (k + 1), -1e20], k % 2) for k in range(6)]
    limit = 2**63 - 1
    assert {(r[4], r[5]) for r in mined(spark, big)} == {(limit, limit)}
    near = [(100 * k, [3e6 + 64 * k, 2e6 * (-1) ** k, 1.0], k % 2) for k in range(8)]  # products beyond 2 ** 53
    assert mined(spark, near) == brute_negatives(near)
    assert mined(spark, [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)]) == brute_negatives([(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)])
    assert mined(spark, [(1, [1.0], 1)]) == mined(spark, []) == []


def test_hard_negatives_beyond_a_long_are_ordered_exactly(spark):
    limit = 2**63 - 1
    rows = [(k, [x * 1e8 for x in v], label) for k, v, label in some_vectors(np.random.default_rng(6), 450, 6)]
    rows += [(1000, [1e-3, 0.5], 1), (1001, [2e-3, 0.5, 3e18], 1), (1002, [1e-3, 0.4, -3e18], 2), (1003, [1e18, 1e30], 2)]
    exact = brute_negatives(rows)
    assert max(r[4] for r in exact) > limit
    assert mined(spark, rows) == sorted(((*r[:4], min(r[4], limit), min(r[5], limit)) for r in exact), key=repr)


def test_bounds_of_leaves_hold_every_score():
    rng = np.random.default_rng(1)
    points = np.floor(256 * rng.normal(size=(400, 5)) * rng.choice([0.1, 1.0], (400, 1)))
    tree = Tree(points[:60], float(np.sqrt((points**2).sum(axis=1).max())), 3)
    leaf, path = tree.leaves(points)
    bounds = {n: (path[leaf == n].min(axis=0).tolist(), path[leaf == n].max(axis=0).tolist()) for n in np.unique(leaf).tolist()}
    named, least, largest = score_bounds(tree, bounds, points[:50])
    for k, n in enumerate(named):
        scores = points[:50] @ points[leaf == n].T
        assert (scores >= least[:, k : k + 1]).all() and (scores <= largest[:, k : k + 1]).all()
    assert (largest.min(axis=1) < largest.max(axis=1) * 0.9).any()  # some leaves are ruled out


# Repeated word sequences

def brute_dedup(rows, window):
    first = {}
    split = [(i, [w for w in re.split("[ \t-\r]+", t or "") if w]) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - window + 1):
            if i is not None:
                w = tuple(words[k : k + window])
                first[w] = min(i, first.get(w, i))
    out = []
    for i, words in split:
        gone = {k + j for k in range(len(words) - window + 1) if i is not None and first[tuple(words[k : k + window])] < i for j in range(window)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def deduped(spark, rows, window=13):
    frame = spark.createDataFrame([(i, t, "en", "x", 1, 2) for i, t in rows], DOCS)
    found = substring_dedup(frame, window)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept"]
    return sorted(((r[0], r[1], r[2], hashlib.sha256(r[3]).hexdigest()) for r in found.collect()), key=repr)


def repetitive(rng, n):
    passages = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(10, 60))) for _ in range(8)]
    passages += ["a " * 12 + "b", "a " * 60, "x " * 13, "x " * 12, "y z " * 30, "é  " * 20]
    texts = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice("pqrst") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(5))]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    return texts


@pytest.mark.parametrize("window", [12, 13, 20])
def test_substring_dedup_equals_brute_force(spark, window):
    rng = random.Random(window)
    texts = repetitive(rng, 160)
    rows = [(rng.randrange(120), t) for t in texts] + [(None, texts[0]), (None, texts[1])]  # ids that repeat
    rows += [(500 + k, t) for k, t in enumerate(ODD + ODD)] + [rows[5], rows[5]]
    got = deduped(spark, rows, window)
    assert got == brute_dedup(rows, window) and sum(r[2] for r in got) > 1000


def test_substring_dedup_in_small_portions(spark, monkeypatch):
    monkeypatch.setattr(recompression_module, "HELD", 20)
    rows = list(enumerate(repetitive(random.Random(1), 120)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert deduped(spark, rows) == brute_dedup(rows, 13)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_substring_dedup_of_many_copies_and_text_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(k, text + (f" {k}" if k % 3 else "")) for k in range(600)] + [(700, "x " + text + " y")]
    assert deduped(spark, rows) == brute_dedup(rows, 13)
    named = [(f"é{i}", t) for i, t in rows]
    frame = spark.createDataFrame(named, "doc_id string, text string")
    assert sorted((r[0], r[1], r[2]) for r in substring_dedup(frame).collect()) == [r[:3] for r in brute_dedup(named, 13)]


def test_substring_dedup_of_nothing(spark):
    assert deduped(spark, []) == []
    with pytest.raises(ValueError, match="12"):
        substring_dedup(spark.createDataFrame([], DOCS), 11)


def test_a_window_has_one_symbol_wherever_it_stands():
    rng = np.random.default_rng(3)
    for turn in range(200):
        window = int(rng.integers(12, 30))
        names = rng.integers(0, 2**63, int(rng.integers(2, 9)), np.uint64)
        inner = rng.choice(names, window)
        seen = set()
        for _ in range(20):
            before, behind = (rng.choice(names, int(rng.integers(0, 5))) for _ in range(2))
            whole = np.concatenate((before, inner, behind))
            seen.add(int(window_symbols(whole, np.zeros(len(whole), np.int64), window, turn)[len(before)]))
        assert len(seen) == 1


def test_long_runs_are_cut_to_what_windows_can_tell():
    own = Windows([b"b " + b"a " * 5000 + b"c", b"", b"a " * 30], 13, 1)
    assert len(own.names) == 25 + 2 + 25 and own.sizes.tolist() == [5002, 0, 30]
    assert own.covered(np.ones(int(own.inside.sum()), bool)).all()


@pytest.mark.parametrize("later", [True, False])
def test_tasks_and_their_followers_agree_with_brute_force(later):
    rng = random.Random(later)
    rows = [(rng.randrange(40), rng.randrange(25)) for _ in range(600)]
    passed = []
    for k in range(0, 600, 50):
        ids, names = zip(*rows[k : k + 50], strict=True)
        passed += settled(pa.array(ids), np.arange(50), np.array(names, np.uint64), np.zeros(50, np.uint32), later).to_pylist()
    passed.sort(key=lambda r: (r["settled"], r["name"], r["check"], r["id"]))
    schema = pa.schema([("settled", pa.bool_()), ("name", pa.int64()), ("check", pa.int32()), ("id", pa.int64())])
    batches = [pa.RecordBatch.from_pylist(passed[k : k + 7], schema) for k in range(0, len(passed), 7)]
    got = {(r["id"], r["name"]) for b in follow(later)(iter([batches[0].slice(0, 0), *batches])) for r in b.to_pylist()}
    ids = defaultdict(set)
    for i, name in rows:
        ids[name].add(i)
    assert got == {(i, name) for name, found in ids.items() for i in found if (i > min(found) if later else len(found) > 1)}
