"""The registered queries of the text operators, each over its whole table, with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meterframe.llm import context_mixing, cover_tree, jaccard_join, merkle, mixing, personal_data, quality, rank_bpe, whitening
from meterframe.llm.common import read_table
from meterframe.llm.token_counts import token_counts
from meterframe.llm.transducer import encode_documents
from meterframe.llm.url_rules import judge
from meterframe.llm.winnowing import fingerprint_edits

# The rules of the registered query.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def find_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.personal_data(read_table(spark, folder, "documents"))


def score_language(spark: SparkSession, folder: str) -> DataFrame:
    return context_mixing.score_documents(read_table(spark, folder, "documents"))


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(read_table(spark, folder, "pages"), rules)


def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_edits(read_table(spark, folder, "documents"))


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(read_table(spark, folder, "documents")).drop("text_hash")


def classify(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, folder, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "mix.*")


def count_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return cover_tree.near_duplicates(read_table(spark, folder, "embeddings"))


def encode(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(read_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def encode_by_ranks(spark: SparkSession, folder: str) -> DataFrame:
    # The words are the matches of public_tokenizers.PATTERN.
    return rank_bpe.encode_documents(
        read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )


def whiten(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read_table(spark, folder, "embeddings"))


def prove(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified(merkle.manifest(read_table(spark, folder, "documents")))


QUERIES = {
    "op1_personal_data": find_personal_data,
    "op2_context_mixing": score_language,
    "op3_url_filter": url_filter,
    "op4_fingerprints": fingerprint,
    "op5_jaccard_join": near_copies,
    "op6_quality": classify,
    "op7_token_counts": count_tokens,
    "op8_cover_tree": near_vectors,
    "op9_bpe_transducer": encode,
    "op10_mix": mix,
    "op11_rank_bpe": encode_by_ranks,
    "op12_whitening": whiten,
    "op13_merkle": prove,
}

ORACLES = {
    "op3_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   CASE WHEN contains(url, '://') THEN
                       regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^([^/?#]*)', 1) ELSE '' END AS raw_host,
                   CASE WHEN contains(url, '://') THEN
                       regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
            FROM pages),
        named AS (
            SELECT page_id, coalesce(translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(path, '') AS path
            FROM parts),
        ruled AS (
            SELECT page_id, host, path,
                   CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
            FROM named)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled
    """,
    "op8_cover_tree": """
        WITH RECURSIVE sound AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        counts AS (SELECT x, count(*) AS n FROM links GROUP BY x),
        roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(root, e.vec_id)) AS component_id,
               e.vec_id <= coalesce(root, e.vec_id) AS kept
        FROM embeddings e LEFT JOIN counts c ON c.x = e.vec_id LEFT JOIN roots r ON r.x = e.vec_id
    """,
    # CRC-32 bit by bit over the decimal id; the trees as lists of levels.
    "op13_merkle": """
        WITH RECURSIVE crc(doc_id, step, value) AS (
            SELECT doc_id, 0, 4294967295::BIGINT FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
            UNION ALL
            SELECT doc_id, step + 1, list_reduce(list_prepend(xor(value, ascii(substr(doc_id::VARCHAR, step + 1, 1))::BIGINT),
                       [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                       lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)
            FROM crc WHERE step < length(doc_id::VARCHAR)),
        chosen AS (
            SELECT doc_id FROM crc WHERE step = length(doc_id::VARCHAR) AND xor(value, 4294967295::BIGINT) % 7 = 0),
        named AS (
            SELECT d.*, row_number() OVER () AS id,
                   CASE WHEN c.doc_id IS NULL THEN n_chars ELSE n_chars + 1 END AS other
            FROM documents d LEFT JOIN chosen c ON c.doc_id = d.doc_id),
        parts AS (
            SELECT id, doc_id, lang,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                       || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                   coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS size,
                   coalesce(strlen(other::VARCHAR) || ':' || other, '-') AS other_size,
                   coalesce(strlen(text) || ':' || text, '-') AS tail
            FROM named),
        hashed AS (
            SELECT id, doc_id, lang, sha256(head || size || tail) AS leaf, sha256(head || other_size || tail) AS other FROM parts),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS place FROM hashed),
        trees AS (
            SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY lang
            UNION ALL
            SELECT lang, level + 1,
                   list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
            FROM trees WHERE len(nodes) > 1),
        subroots AS (SELECT lang, nodes[1] AS subroot FROM trees WHERE len(nodes) = 1),
        top_leaves AS (
            SELECT lang, subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM subroots),
        tops AS (
            SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM top_leaves
            UNION ALL
            SELECT level + 1,
                   list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
            FROM tops WHERE len(nodes) > 1),
        root AS (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1),
        low AS (SELECT lang, level, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS place FROM trees WHERE len(nodes) > 1),
        high AS (SELECT level, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS place FROM tops WHERE len(nodes) > 1),
        depths AS (SELECT lang, max(level) AS depth FROM trees GROUP BY lang),
        steps AS (
            SELECT l.id, n.level, l.place // (1 << n.level) AS place, s.node AS sibling
            FROM leaves l JOIN (SELECT DISTINCT lang, level FROM low) n ON n.lang IS NOT DISTINCT FROM l.lang
            LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = n.level
                AND s.place = xor(l.place // (1 << n.level), 1)
            UNION ALL
            SELECT l.id, d.depth + n.level, t.place // (1 << n.level), s.node
            FROM leaves l JOIN top_leaves t ON t.lang IS NOT DISTINCT FROM l.lang
            JOIN depths d ON d.lang IS NOT DISTINCT FROM l.lang
            CROSS JOIN (SELECT DISTINCT level FROM high) n
            LEFT JOIN high s ON s.level = n.level AND s.place = xor(t.place // (1 << n.level), 1)),
        paths AS (
            SELECT id, list({'place': place, 'sibling': coalesce(sibling, '')} ORDER BY level) AS path,
                   string_agg(coalesce(sibling, ''), '' ORDER BY level) AS siblings
            FROM steps GROUP BY id),
        folds(id, step, own) AS (
            SELECT id, 1::BIGINT, other FROM leaves
            UNION ALL
            SELECT f.id, f.step + 1, CASE WHEN p.path[f.step].place % 2 = 1 THEN sha256(p.path[f.step].sibling || f.own)
                                        ELSE sha256(f.own || p.path[f.step].sibling) END
            FROM folds f JOIN paths p USING (id) WHERE f.step <= len(p.path)),
        ends AS (SELECT id, arg_max(own, step) AS folded_root FROM folds GROUP BY id)
        SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, e.folded_root,
               e.folded_root = r.root AS verified
        FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN root r
        LEFT JOIN paths p ON p.id = l.id JOIN ends e ON e.id = l.id
    """,
}
