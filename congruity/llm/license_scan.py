"""Licence detection with a positional rare-token index.

The index is a table of postings (word, template, offset) of each template's rarest
words by document frequency: as many as weigh together more than a place may lack.
So a place without any of them cannot reach the share that labels it, and the words
of a file that are in the index are its licence words of highest IDF. Each of them is
looked up; a posting proposes where the template would start, and the words around
are intersected with the template's by relative position, weighted by IDF. A label
needs enough of that weight and all key phrases of the template. All steps are
DataFrame operations; texts are read twice and never shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged, words_of
from .license_texts import TEMPLATES, Template

#: Phrases whose consecutive words give a label by themselves.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: The least share of a template's weight that labels a place, by how many words one may
#: stand off its place, and for how many words between it and the rare word one more.
SHARE, SLACK, DRIFT = 0.8, 3, 10
#: Shares below this are not told apart: they count as none. Words of a block.
FLOOR, BLOCK = 0.5, 4096


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def inverse_frequencies(docs_words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each licence word over all documents; as many rows as the templates have
    words, and one (of the empty word) for the number of documents."""
    own = F.array_distinct(F.filter("words", lambda w: w.isin(*vocabulary)))
    counts = docs_words.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    seen = {r["word"]: r["count"] for r in counts}
    n = seen.get("", 0)
    return {w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1 for w in vocabulary}


def rare_offsets(words: list[str], idf: dict[str, float], share: float = SHARE) -> list[int]:
    """Offsets of all occurrences of the rarest words, which together weigh more than
    a place may lack."""
    room, chosen = (1 - share) * sum(idf[w] for w in words) + 1e-9, set()
    for w in sorted(set(words), key=lambda w: (-idf[w], w)):
        if room < 0:
            break
        chosen.add(w)
        room -= idf[w] * words.count(w)
    return [k for k, w in enumerate(words) if w in chosen]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    Words are runs of digits, a-z and characters beyond ASCII after lower-casing
    A-Z; null text is empty. n_base counts every place of a base phrase,
    first_word and last_word are the least and greatest start (null without any).
    labels adds to base_labels what the templates give, in alphabetical order however
    many reach the share; score is the largest share of a template's IDF weight found
    at one place if it is FLOOR or more, 1 where a base phrase stands, else 0. Words may
    stand SLACK words off, and further with their distance from the rare word. Very long
    texts are scanned in blocks, with the same result. Rows with equal or null ids are
    scanned one by one; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    words = words_of(ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), words.alias("words"))
    split, phrases = [template_words(t.text) for t in templates], {p: p.split() for p in base}
    idf = inverse_frequencies(rows, sorted({w for ws in (*split, *phrases.values()) for w in ws}))

    postings = [(ws[k], n, k) for n, ws in enumerate(split) for k in rare_offsets(ws, idf)]
    index, longest = sorted({w for w, _, _ in postings}), max((len(ws) for ws in split), default=0)
    reach = SLACK + longest // DRIFT
    anchor = {p: max(range(len(ws)), key=lambda k, ws=ws: (idf[ws[k]], -k)) for p, ws in phrases.items()}
    marked = F.transform("words", lambda w, i: F.when(w.isin(*index, *(phrases[p][k] for p, k in anchor.items())), i))
    rows = rows.withColumn("spots", F.filter(marked, lambda i: i.isNotNull()))

    def places(p: str) -> Column:
        """Starts of a base phrase: where its rarest word stands among the others."""
        ws, k = phrases[p], anchor[p]

        def stands(i: Column) -> Column:
            out = F.lit(True)
            for j, w in enumerate(ws):
                out = out & F.coalesce(F.get("words", i + F.lit(j - k)) == F.lit(w), F.lit(False))
            return out

        return F.transform(F.filter("spots", stands), lambda i: i - F.lit(k))

    margin = longest + reach
    vocabulary = sorted({w for ws in split for w in ws})

    def block(b: Column) -> Column:
        """The words from ``margin`` before a block to ``margin`` behind it, the licence
        words among them, and where the block's own rare words stand."""
        first = F.greatest(b * BLOCK - F.lit(margin), F.lit(0))
        own = F.slice("words", first + 1, F.lit(BLOCK + 2 * margin))
        spots = F.transform(F.filter("rare", lambda i: F.floor(i / BLOCK) == b), lambda i: i - first)
        return F.struct(b.alias("block"), own.alias("words"), F.array_distinct(F.filter(own, lambda w: w.isin(*vocabulary))).alias("bag"), spots.alias("spots"))

    rows = rows.withColumn("rare", F.filter("spots", lambda i: F.get("words", i).isin(*index)))
    blocks = F.array_distinct(F.transform("rare", lambda i: F.floor(i / BLOCK).cast("int")))
    rows = rows.withColumns({f"base_{n}": places(p) for n, p in enumerate(phrases)})
    every = F.concat(*(F.col(f"base_{n}") for n in range(len(phrases))))
    scanned = staged(
        rows.select(
            F.monotonically_increasing_id().alias("key"),
            id_col,
            F.size("words").cast("long").alias("n_words"),
            F.size(every).cast("long").alias("n_base"),
            F.array_min(every).cast("long").alias("first_word"),
            F.array_max(every).cast("long").alias("last_word"),
            F.array_compact(F.array(*(F.when(F.size(f"base_{n}") > 0, F.lit(label)) for n, label in enumerate(base.values())))).alias("base_labels"),
            F.transform(blocks, block).alias("blocks"),
        )
    )

    # As many rows as the templates have words: a proven bound for the broadcasts.
    index_table = spark.createDataFrame(sorted({(w, n) for w, n, _ in postings}), "word string, template int")
    template_table = spark.createDataFrame(
        [
            (n, t.label, [(w, idf[w] / sum(idf[x] for x in ws)) for w in ws], [f" {' '.join(template_words(p))} " for p in t.key_phrases], [(w, k) for w, m, k in postings if m == n])
            for n, (t, ws) in enumerate(zip(templates, split, strict=True))
        ],
        "template int, label string, parts array<struct<word:string,weight:double>>, phrases array<string>, postings array<struct<word:string,offset:int>>",
    )
    near = scanned.select("key", F.explode("blocks").alias("b")).select("key", "b.*")
    met = near.select("key", "block", F.explode("bag").alias("word")).join(F.broadcast(index_table), "word").select("key", "block", "template").distinct()
    found = near.join(met, ["key", "block"]).join(F.broadcast(template_table), "template")
    bound = F.aggregate("parts", F.lit(0.0), lambda a, p: a + F.when(F.array_contains("bag", p["word"]), p["weight"]).otherwise(0.0))
    found = found.filter(bound >= FLOOR - 1e-9)

    def posted(i: Column) -> Column:
        """Where the template would start, by each posting of the rare word at ``i``."""
        own = F.filter("postings", lambda p: p["word"] == F.get("words", i))
        return F.transform(own, lambda p: F.struct((i - p["offset"]).alias("start"), p["offset"].alias("offset")))

    def stretch(start: Column, n: Column) -> Column:
        first = F.greatest(start, F.lit(0))
        return F.slice("words", first + 1, F.greatest(start + n - first, F.lit(0)))

    def share(c: Column) -> Column:
        def weight(p: Column, k: Column) -> Column:
            slack = F.lit(SLACK) + F.floor(F.abs(k - c["offset"]) / DRIFT).cast("int")
            return F.when(F.array_contains(stretch(c["start"] + k - slack, slack * 2 + 1), p["word"]), p["weight"]).otherwise(0.0)

        return F.aggregate(F.transform("parts", weight), F.lit(0.0), lambda a, x: a + x)

    def whole(c: Column) -> Column:
        text = F.concat(F.lit(" "), F.array_join(stretch(c["start"] - F.lit(reach), F.size("parts") + F.lit(2 * reach)), " "), F.lit(" "))
        return F.forall("phrases", lambda p: text.contains(p))

    starts = F.array_distinct(F.flatten(F.transform("spots", posted)))
    scored = found.select("key", "label", "words", "parts", "phrases", F.transform(starts, lambda c: F.struct(c["start"].alias("start"), share(c).alias("share"))).alias("places"))
    good = F.exists("places", lambda c: F.when(c["share"] >= SHARE - 1e-9, whole(c)).otherwise(F.lit(False)))
    best = scored.select("key", F.array_max(F.transform("places", lambda c: c["share"])).alias("share"), F.when(good, F.col("label")).alias("label"))
    best = best.groupBy("key").agg(F.least(F.coalesce(F.max(F.when(F.col("share") >= FLOOR - 1e-9, F.col("share"))), F.lit(0.0)), F.lit(1.0)).alias("share"), F.collect_set("label").alias("more"))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return scanned.drop("blocks").join(best, "key", "left").select(
        id_col,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base_labels")).alias("base_labels"),
        joined(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
