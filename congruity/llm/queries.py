"""Queries of the training-data operators over their whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .chat_format import format_chats, read_back
from .collocations import collocations
from .common import shared_dir, table
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .html_text import html_text
from .jaccard_join import jaccard_join
from .license_scan import license_scan
from .quality import quality
from .recompression import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_files import read_token_files, with_crc32, write_token_files


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return with_crc32(read_token_files(spark, path))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    path = shared_dir(spark)
    format_chats(turns.unionByName(control)).write.parquet(path)
    return read_back(spark, path)


def token_digests(docs: DataFrame) -> DataFrame:
    tokens = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_size", "n_links")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "first_word", "last_word")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest").drop("text_hash")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_files": op3_token_files,
    "op4_chat_format": op4_chat_format,
    "op5_bpe": op5_bpe,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLES = {
    "op4_chat_format": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), g AS (
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
                   coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS loss
            FROM t GROUP BY conv_id
        ), e AS (
            SELECT conv_id, role, turn, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 4 AS tokens,
                   20 + length(role) + length(text) + (length(text) - length(replace(text, chr(92), '')))
                   + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
                   + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7 AS written
            FROM t
        ), r AS (
            SELECT *, sum(tokens) OVER o AS upto, row_number() OVER o AS position FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY turn)
        ), w AS (SELECT *, CAST((upto - 1) // 512 AS BIGINT) AS window_id FROM r
        ), f AS (SELECT conv_id, window_id, min(position) AS first_own FROM w GROUP BY ALL
        ), again AS (
            SELECT w.conv_id, f.window_id, w.position, w.written FROM w JOIN f ON f.conv_id = w.conv_id AND f.window_id = w.window_id + 1
            WHERE (w.window_id + 1) * 512 - (upto - tokens) <= 256
        ), s AS (
            SELECT conv_id, min(position) AS at, arg_min(written, position) AS written FROM w WHERE role = 'system' GROUP BY conv_id
        ), c AS (
            SELECT conv_id, written FROM w UNION ALL SELECT conv_id, written FROM again
            UNION ALL SELECT f.conv_id, s.written FROM f JOIN s ON s.conv_id = f.conv_id AND s.at < f.first_own
            WHERE NOT EXISTS (SELECT 1 FROM again a WHERE a.conv_id = f.conv_id AND a.window_id = f.window_id AND a.position = s.at)
        )
        SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
               (SELECT CAST(sum(written) AS BIGINT) FROM c WHERE c.conv_id = g.conv_id) AS formatted_chars
        FROM g
    """,
    "op6_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents
        ), sh AS (
            SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END, ' ') AS s
            FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS r(i) WHERE len(ws) > 0
        ), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
        ), c AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (
            SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE c.c * 5 >= (p.n + q.n - c.c) * 4
            UNION ALL SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON len(a.ws) = 0 AND len(b.ws) = 0 AND a.doc_id < b.doc_id
        ), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
        ), reach(doc_id, root) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON e.x = r.root
        ), g AS (SELECT doc_id, min(root) AS class_id, count(*) AS group_size FROM reach GROUP BY doc_id)
        SELECT doc_id, class_id, group_size, (SELECT count(*) FROM e WHERE e.x = g.doc_id) AS n_links FROM g
    """,
    "op9_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY norm)
    """,
    "op11_collocations": r"""
        WITH t AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ), p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t
        ), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p
        ), n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
        ), f AS (
            SELECT lang, k, phrase, count(*) AS f
            FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(ws) >= k)
            GROUP BY lang, k, phrase
        ), c AS (SELECT * FROM f WHERE k > 1 AND f >= 10
        ), cut AS (
            SELECT lang, k, phrase, f AS a, j, array_to_string(string_split(phrase, ' ')[:j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS tail
            FROM c, (VALUES (1), (2)) AS v(j) WHERE j < k
        ), s AS (
            SELECT cut.*, x.f AS l, y.f AS r, CAST(CAST(a AS HUGEINT) * a * 1000000 // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail
            QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, j) = 1
        ), z AS (
            SELECT lang, phrase, max(f) AS longer
            FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM c WHERE k = 3)
            GROUP BY lang, phrase
        )
        SELECT s.lang, row_number() OVER o AS rank, s.phrase, a, l, r, n, score
        FROM s JOIN n ON n.lang = s.lang LEFT JOIN z ON z.lang = s.lang AND z.phrase = s.phrase
        WHERE longer IS NULL OR 100 * longer < 50 * a
        WINDOW o AS (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase)
        QUALIFY rank <= 2000
    """,
    "op13_substring_dedup": r"""
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ), w AS (
            SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS name FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM t WHERE len(ws) >= 13)
        ), f AS (SELECT name, min(doc_id) AS first FROM w GROUP BY name
        ), c AS (SELECT DISTINCT doc_id, i + j AS pos FROM w JOIN f USING (name), unnest(range(0, 13)) AS r(j) WHERE doc_id > first
        ), g AS (SELECT doc_id, list(pos) AS gone, count(*) AS n_removed FROM c GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
        FROM t LEFT JOIN g USING (doc_id)
    """,
    "op12_hard_negatives": r"""
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY rank <= 5
    """,
}
