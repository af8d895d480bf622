"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import ce_difference, conversation_repair, grid_codes, language_id, license_scan, lpt_sharding, merge_dropout, quality_crf, secret_scan, simhash_trie, suffix_decontam, trie_token_counts, warc_index
from matchloom.llm.common import materialize, table


def op1_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_quality_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = materialize(quality_crf.measured(table(spark, sf_dir, "documents")), "line-features")
    return quality_crf.judged(lines, quality_crf.fit_measured(lines, table(spark, sf_dir, "labels")))


def op3_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.archived_pages(table(spark, sf_dir, "pages"))


def op4_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.round_trip(table(spark, sf_dir, "documents"))


def op6_subword_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def held_out(doc_id):
        return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))

    model = language_id.fit_languages(docs.where(~held_out(F.col("doc_id"))))
    return language_id.predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def op7_secret_trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op8_suffix_array_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ce_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ce_difference.ce_difference(docs, ce_difference.fit_tables(docs, table(spark, sf_dir, "labels")))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))


def op11_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op12_grid_cell_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_codes.coded_vectors(table(spark, sf_dir, "embeddings"))


def op13_survivor_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_trie_token_counts": op1_trie_token_counts,
    "op2_quality_line_crf": op2_quality_line_crf,
    "op3_warc_capture_index": op3_warc_capture_index,
    "op4_lpt_sharding": op4_lpt_sharding,
    "op5_merge_dropout": op5_merge_dropout,
    "op6_subword_language_id": op6_subword_language_id,
    "op7_secret_trigram_index": op7_secret_trigram_index,
    "op8_suffix_array_decontam": op8_suffix_array_decontam,
    "op9_ce_difference": op9_ce_difference,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_license_set_join": op11_license_set_join,
    "op12_grid_cell_codes": op12_grid_cell_codes,
    "op13_survivor_viterbi": op13_survivor_viterbi,
}
#: Where SQL can express the contract; the others are tested against brute force,
#: exact round trips or held-out accuracy in tests/llm.
ORACLES: dict[str, str] = {
    "op3_warc_capture_index": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        q AS (SELECT *, payload_bytes >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY payload_digest) AS again, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM q
    """,
    "op8_suffix_array_decontam": """
        WITH RECURSIVE words(kind, id, w) AS (
            SELECT 'd', doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM documents
            UNION ALL
            SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        items AS (SELECT id, w, least(10, len(w)) AS n FROM words WHERE kind = 'b' AND len(w) > 0),
        windows AS (SELECT DISTINCT id AS item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (SELECT id AS doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE kind = 'd' AND len(w) >= n)),
        found AS (SELECT DISTINCT doc_id, i, p.n, item_id FROM places p JOIN windows USING (n, win)),
        hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
        SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hits ON hits.doc_id = id LEFT JOIN named ON named.doc_id = id WHERE kind = 'd'
    """,
    "op11_license_set_join": license_scan.scan_sql(),
    "op12_grid_cell_codes": grid_codes.codes_sql(),
    "op13_survivor_viterbi": conversation_repair.repair_sql(),
}
