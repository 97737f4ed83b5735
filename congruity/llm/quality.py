"""Quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled texts. A text
is compressed with either, stretch by stretch and to its end; what the bad
dictionary needs more than the good one, over the size, is the evidence, and a
logistic curve fitted on other labelled texts turns it into a probability.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices, staged

#: Labelled rows of each class that a fit takes at most, and bytes of their texts that
#: the dictionaries learn from.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 8 << 20
#: Bytes of a dictionary, bytes of a stretch, compression level.
DICTIONARY, STRETCH, LEVEL = 64 << 10, 1024, 3
THRESHOLD = 0.3
#: Bytes added to a size, so that a few words weigh little.
SMOOTH = 64


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def stretches(data: bytes) -> list[bytes]:
    """The whole text in equal parts of about STRETCH bytes."""
    n = max(1, round(len(data) / STRETCH))
    at = [len(data) * k // n for k in range(n + 1)]
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def allotment(sizes: list[int], room: int) -> int:
    """The most bytes of one text, so that all texts together stay within ``room``."""
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > room:
            return room // (len(sizes) - k)
        room -= n
    return max(sizes, default=0)


def spread(data: bytes, most: int) -> list[bytes]:
    """The whole text in stretches, or ``most`` bytes in stretches spread over it."""
    parts = stretches(data)
    if len(data) <= most:
        return parts
    n = max(1, min(most // STRETCH, len(parts)))
    return [parts[len(parts) * k // n][: most // n] for k in range(n)]


class Scorer:
    def __init__(self, good: bytes, bad: bytes, weights: tuple[float, ...] = ()):
        self.good, self.bad = (self.compressor(d) for d in (good, bad))
        self.weights = np.array(weights)

    @staticmethod
    def compressor(data: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)

    def evidence(self, text: str) -> tuple[float, ...]:
        """A constant; the normalised difference of all stretches; that of the worst
        one; the normalised size with the good dictionary, which repetition lowers."""
        data = text.encode("utf-8", "replace")
        if not data:
            return 1.0, 0.0, 0.0, 0.4
        parts = stretches(data)
        good = [len(self.good.compress(p)) for p in parts]
        more = [len(self.bad.compress(p)) - n for p, n in zip(parts, good, strict=True)]
        n = len(data) + SMOOTH
        return 1.0, sum(more) / n, min(m / (len(p) + SMOOTH) for m, p in zip(more, parts, strict=True)), min(0.4, sum(good) / len(data))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights @ np.array(self.evidence(text)), -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (w * (y - p)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labelled rows whose crc32(doc_id) mod 5 is not 0.

    The sample holds at most ``sample_rows`` rows of each class, those of the
    smallest hash of doc_id; of an id that repeats, the least text and the lower label. Where their
    texts exceed ``sample_bytes``, the dictionaries learn from stretches spread over
    each of the longest; the curve is fitted on whole texts. Rows with null labels, ids or texts, or with empty texts, are no
    examples. With an empty class the model scores every text by the share of
    good labels (0.5 without any).
    """
    pool = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in pool.groupBy("quality").count().collect()}
    chosen = None
    for q in (0, 1):
        part = pool.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * sample_rows ids: a proven bound for the broadcast. An id's rows become
    # one before anything is collected.
    rows = docs.select("doc_id", "text").filter("text != ''").join(F.broadcast(chosen), "doc_id")
    rows = staged(rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")))
    sizes = rows.select("doc_id", "quality", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    by = {q: [r for r in sizes if r["quality"] == q] for q in (0, 1)}
    total = sum(counts.values())
    if min(len(by[0]), len(by[1])) < 8:
        share = counts.get(1, 0) / total if total else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        if total:
            logging.getLogger(__name__).warning("%d labelled rows, but only %d bad and %d good texts: every text gets the score %.3f", total, len(by[0]), len(by[1]), share)
        return Model(b"", b"", (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))

    most = {q: allotment([r["n"] for r in by[q]], sample_bytes) for q in (0, 1)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [spread(t.as_py().encode("utf-8", "replace"), most[q.as_py()]) for q, t in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.binary()))], ["doc_id", "parts"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(good, bad)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.evidence(t.as_py()) for t in batch.column(2)], pa.list_(pa.float64()))], ["doc_id", "evidence"])

    def of(ids: list, f, column: str) -> dict:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return {r["doc_id"]: r[1] for r in rows.filter(F.col("doc_id").isin(ids)).select("doc_id", "quality", "text").mapInArrow(f, f"doc_id {kind}, {column}").collect()}

    # Dictionaries are trained on bounded stretches here; the others are weighed whole on executors.
    taught = {q: [r["doc_id"] for r in by[q][::2]] for q in (0, 1)}
    stretched = of(taught[0] + taught[1], cut, "parts array<binary>")

    def dictionary(q: int) -> bytes:
        parts = [bytes(p) for i in taught[q] for p in stretched[i]]
        size = min(DICTIONARY, max(1024, sum(map(len, parts)) // 8))
        try:
            return zstandard.train_dictionary(size, parts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself
            return b"".join(parts)[-DICTIONARY:]

    good, bad = dictionary(1), dictionary(0)
    rest = {q: [r["doc_id"] for r in by[q][1::2]] for q in (0, 1)}
    evidence = of(rest[0] + rest[1], weigh, "evidence array<double>")
    x = np.array([evidence[i] for q in (0, 1) for i in rest[q]])
    y = np.array([float(q) for q in (0, 1) for _ in rest[q]])
    w = np.array([counts[q] / total / len(rest[q]) for q in (0, 1) for _ in rest[q]])
    return Model(good, bad, tuple(logistic(x, y, w * len(y))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score``: 0 to 1, higher for better text.

    Null texts count as empty and get the curve's value without evidence. Every
    row is scored by its text alone; a column named score is replaced; an empty
    table gives an empty result.
    """
    names = [c for c in docs.columns if c != "score"]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(model.good, model.bad, model.weights)
        for batch in in_slices(batches):
            found = [own.score(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*names, "score"])

    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on) of every row."""
    found = score(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
