"""The registered queries of the operators and the SQL they are checked against."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import exact_dedup, language_id, near_dedup, packing, phrase_dedup, pieces, pii, prefix_trie, quality, suffix_dedup, token_files, top_k, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language_id.train(docs.filter(~language_id.held_out()))
    found = language_id.predict(docs, model)
    return found.select("doc_id", F.coalesce(language_id.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classified(_documents(spark, sf_dir)).drop("key")


def op3_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.digests(_documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).read()


def op5_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_column_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_documents(spark, sf_dir))


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_documents(spark, sf_dir))


def op8_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op10_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.owners(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.filter(~quality.held_out()))
    found = quality.scored(docs, model)
    return found.select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op12_splitter_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_partial_matching, op2_bayesian_minhash, op3_phrase_automata, op4_token_files, op5_suffix_array_pieces, op6_column_suffixes, op7_disclosure, op8_hierarchical_packing, op9_branch_and_bound, op10_patricia_owners, op11_support_vectors, op12_splitter_skeleton, op13_refined_whitening)}

ORACLES: dict[str, str] = {
    "op9_branch_and_bound": """
        WITH whole AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
                   row_number() OVER (PARTITION BY q.row ORDER BY score DESC, c.vec_id)::INTEGER AS rank
            FROM whole q JOIN whole c ON q.row <> c.row WHERE q.vec_id % 20 = 0)
        SELECT query_id, rank, vec_id, score FROM scored WHERE rank <= 20""",
    "op10_patricia_owners": r"""
        WITH bare AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               row_number() OVER best = 1 AS kept, sha256(body) AS text_sha256
        FROM bare WINDOW best AS (PARTITION BY body ORDER BY chars DESC, doc_id)""",
    "op12_splitter_skeleton": """
        WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        own AS (
            SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns,
                   xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                       lambda c, x: list_reduce(list_concat([xor(c, x)], list_transform(range(8), lambda i: 0::BIGINT)),
                           lambda r, i: xor(r >> 1, (r & 1) * 3988292384))), 4294967295) % 9 AS h
            FROM said GROUP BY conv_id),
        rebuilt AS (
            SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS path
            FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
        begun AS (SELECT conv_id, len(path) AS n, unnest(range(len(path) + 1)) AS depth, path FROM rebuilt),
        keyed AS (SELECT conv_id, n, depth, path[1:depth] AS key FROM begun),
        node AS (
            SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(octet_length(encode(any_value(key[depth].text))), 0) AS bytes,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
            FROM keyed GROUP BY key, depth),
        child AS (SELECT key[1:depth - 1] AS key, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
        counted AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (key, depth)),
        upward AS (SELECT key, unnest(range(depth + 1)) AS upto, (n_convs - 1) * bytes AS saved, (n_children = 0)::BIGINT AS leaf FROM counted),
        below AS (SELECT key[1:upto] AS key, upto AS depth, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM upward GROUP BY ALL)
        SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
        FROM counted c JOIN below USING (key, depth) LEFT JOIN counted p ON p.depth = c.depth - 1 AND p.key = c.key[1:c.depth - 1]""",
}
