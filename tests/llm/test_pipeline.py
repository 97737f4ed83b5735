"""The pipeline against its stages done by hand."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from congruity.llm import quality

from .test_operators import DOCS, ODD, brute_links, prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(20)
    items = [prose(30, rng, 4000) for _ in range(3)]
    texts = [*ODD, *(prose(rng.randrange(20, 150), rng, 4000) for _ in range(120))]
    texts += [t.upper() for t in texts[20:40]] + [" ".join([*t.split()[:-1], "end"]) for t in texts[40:50]] + [f"{prose(20, rng)} {i} {prose(20, rng)}" for i in items]
    marks = [1] * len(texts)
    for k in range(60):
        texts.append(" ".join(w.upper() + "$$$%%" for w in prose(60, rng).split()))
        marks.append(0)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scorer = quality.Scorer(model.good, model.bad, model.weights)
    kept = [i for i, t in enumerate(texts) if scorer.score(t or "") >= 0.3]
    assert not [i for i in kept if zlib.crc32(str(i).encode()) % 5 == 0 and marks[i] == 0]
    last = {}
    for i in kept:
        last["".join(c.lower() if c.isascii() else c for c in texts[i] or "")] = i
    kept = sorted(last.values())
    _, root = brute_links([texts[i] for i in kept])
    kept = [i for k, i in enumerate(kept) if root[k] == k]
    kept = [i for i in kept if not any(x in " ".join(re.findall(r"\w+", (texts[i] or "").lower())) for x in (" ".join(re.findall(r"\w+", t.lower())) for t in items))]
    assert sorted(got) == kept
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i in kept:
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_repeated_and_null_ids(spark, tmp_path):
    rng = random.Random(31)
    a, b, c, d, e = (prose(60, rng, 4000) for _ in range(5))
    near = " ".join([*e.split()[:-1], "end"])
    rows = [(1, a), (1, a), (None, b), (None, b), (2, c), (2, d), (None, None), (None, ""), (3, e), (3, near), (None, e.upper()), (4, f"{a} and more {prose(300, rng)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    digest = lambda text: hashlib.sha256(np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    want = {(1, digest(a)), (None, digest(b)), (2, digest(c)), (2, digest(d)), (None, digest("")), (4, digest(rows[-1][1]))}
    assert len(got) == len(want) + 1 and want < set(got) and {g for g in got if g not in want} <= {(3, digest(e)), (3, digest(near))}


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
