"""The thin queries over the given tables, and the SQL that checks them where SQL can."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm import fingerprint, infill, jaccard, langid, mixing, packing, pii, prefixtrie, quality, substrings, topk, toxicity, warc
from pitchframe.llm.common import crc32_bucket, table

TOKENIZER = "word_bpe_49k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_bucket("doc_id", 4) == 2, F.lit(False))
    profiles = langid.fit_on(held_out, docs)
    return langid.identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_bucket("doc_id", 5) == 0, F.lit(False))
    trees = quality.fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.quality_scores(docs, trees).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_winnowed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_bucket("doc_id", 5) == 0, F.lit(False))
    index = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.toxicity_scores(docs, index).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_source_mixing": op2_source_mixing,
    "op3_exact_topk": op3_exact_topk,
    "op4_shingle_jaccard": op4_shingle_jaccard,
    "op5_quality_trees": op5_quality_trees,
    "op6_winnowed_fingerprints": op6_winnowed_fingerprints,
    "op7_warc_round_trip": op7_warc_round_trip,
    "op8_personal_data": op8_personal_data,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_toxicity": op12_toxicity,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op3_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
            FROM embeddings
            WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), FALSE)))
        ),
        scored AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.c, v.c) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
        ),
        ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r, vec_id, score FROM scored
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
    """,
    "op4_shingle_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
            FROM words
        ),
        shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
        links AS MATERIALIZED (
            SELECT a.doc_id AS x, b.doc_id AS y
            FROM shingles AS a JOIN shingles AS b
              ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ),
        paired AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(x, y) AS (SELECT x, y FROM paired UNION SELECT r.x, b.y FROM reach AS r JOIN paired AS b ON b.x = r.y)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
               least(doc_id, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id)) AS component_id
        FROM sets
    """,
    "op10_substring_dedup": r"""
        WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS MATERIALIZED (
            SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50)
        ),
        earliest AS (SELECT k, min(doc_id) AS f FROM windows GROUP BY k),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p
            FROM windows JOIN earliest USING (k) WHERE f < doc_id
        ),
        listed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
            FROM listed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM words LEFT JOIN kept USING (doc_id)
    """,
    "op11_conversation_trie": r"""
        WITH turns AS (
            SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS l
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ),
        borrowing AS (
            -- crc32 of the decimal id, bit by bit
            SELECT c, l, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]),
                    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 4 AS h
            FROM turns
        ),
        rebuilt AS (
            SELECT b.c, list_concat(coalesce(list_slice(o.l, 1, b.h), []), list_slice(b.l, b.h + 1, len(b.l))) AS l
            FROM borrowing AS b LEFT JOIN turns AS o ON o.c = b.c - b.c % 20
        ),
        steps AS MATERIALIZED (
            SELECT c, d, len(l) AS whole, sha256(CAST(list_slice(l, 1, d) AS VARCHAR)) AS k, sha256(CAST(list_slice(l, 1, d - 1) AS VARCHAR)) AS up,
                   CASE WHEN d > 0 THEN len(regexp_extract_all(l[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w
            FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)
        ),
        nodes AS MATERIALIZED (
            SELECT d, k, min(up) AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * min(w) AS s,
                   sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = whole), '')) AS ends
            FROM steps GROUP BY d, k
        ),
        families AS MATERIALIZED (
            SELECT p.d, p.k, count(x.k) AS children FROM nodes AS p LEFT JOIN nodes AS x ON x.d = p.d + 1 AND x.up = p.k GROUP BY p.d, p.k
        ),
        below AS (
            -- a node lies on the path of its smallest member, and so do all above it
            SELECT a.d, a.k, sum(n.s) AS saved, sum((f.children = 0)::INT) AS leaves
            FROM nodes AS n JOIN families AS f ON f.d = n.d AND f.k = n.k JOIN steps AS a ON a.c = n.c AND a.d <= n.d
            GROUP BY a.d, a.k
        )
        SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs, f.children AS n_children,
               CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
        FROM nodes AS n JOIN families AS f ON f.d = n.d AND f.k = n.k JOIN below AS b ON b.d = n.d AND b.k = n.k
        LEFT JOIN nodes AS p ON n.d > 0 AND p.d = n.d - 1 AND p.k = n.up
    """,
    "op13_fill_in_middle": r"""
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
            FROM documents
        ),
        numbers AS (
            SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
                        WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        ),
        parts AS (
            SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
                   array_to_string(u[greatest(a, b) + 1:], '') AS s
            FROM numbers
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts
    """,
}
