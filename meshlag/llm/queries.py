"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meshlag.llm.decontamination import find_contaminated
from meshlag.llm.imatch import fingerprint_edits
from meshlag.llm.licenses import scan_licenses
from meshlag.llm.packing import pack_documents
from meshlag.llm.quality import score_quality
from meshlag.llm.resampling import resample_towards
from meshlag.llm.search import rank_documents
from meshlag.llm.set_join import join_documents
from meshlag.llm.sharding import assign_shards
from meshlag.llm.simhash import group_near_duplicates
from meshlag.llm.token_counts import count_tokens
from meshlag.llm.toxicity import score_toxicity
from meshlag.llm.urls import RULES, filter_urls
from meshlag.llm.util import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_near_duplicates(table(spark, sf_dir, "documents"))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).drop("text")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_towards(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_imatch_fingerprints, op3_simhash_groups, op4_pack_sequences, op5_toxicity, op6_decontaminate, op7_license_scan,
        op8_shard_documents, op9_url_filter, op10_quality, op11_resample, op12_ranked_search, op13_jaccard_join, pipeline,
    )
}

_fits = " UNION ALL ".join(f"SELECT '{r}' AS rule, '{r.partition('/')[0]}' AS rh, '/{r.partition('/')[2]}' AS rp, '{v}' AS rv" for r, v in RULES.items())

ORACLE_SQL: dict[str, str] = {
    "op9_url_filter": rf"""
        WITH parts AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        rules AS ({_fits}),
        best AS (
            SELECT p.page_id, p.host, p.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.rv, length(r.rule)) AS rv
            FROM parts p LEFT JOIN rules r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp)
            GROUP BY p.page_id, p.host, p.path)
        SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM best
    """,
    # digits: the CRC-32 of each half byte; a feature's hexadecimal digits are folded in, the lower one of a byte first
    "op11_resample": r"""
        WITH digits AS (
            SELECT list(list_reduce([i, 1, 2, 3, 4], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
            FROM (SELECT unnest(range(16))::BIGINT AS i)),
        texts AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
        worded AS (
            SELECT side, id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM texts),
        grams AS (
            SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                      || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
            FROM worded),
        halves AS (
            SELECT g, [4294967295] || list_transform(range(strlen(g) * 2), lambda i: (instr('0123456789ABCDEF', hex(g)[xor(i, 1) + 1]) - 1)::BIGINT) AS h
            FROM (SELECT DISTINCT g FROM grams)),
        buckets AS (SELECT g, xor(list_reduce(h, lambda c, x: xor(c >> 4, tab[xor(c & 15, x) + 1])), 4294967295) % 10000 AS bucket FROM halves, digits),
        placed AS (SELECT side, id, bucket FROM grams JOIN buckets USING (g)),
        counts AS (
            SELECT k AS bucket, count(*) FILTER (side = 's')::DOUBLE AS s, count(*) FILTER (side = 't')::DOUBLE AS t
            FROM (SELECT unnest(range(10000)) AS k) LEFT JOIN placed ON k = bucket GROUP BY k),
        gains AS (
            SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts),
        weights AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE side = 's' GROUP BY id),
        scored AS (
            SELECT id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM worded LEFT JOIN weights USING (id) WHERE side = 's'),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, id) AS place, count(*) FILTER (n_words >= 20) OVER () AS eligible FROM scored)
        SELECT id AS doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * eligible // 100 THEN place END AS rank FROM ranked
    """,
    "op12_ranked_search": r"""
        WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
        terms AS (
            SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM texts),
        items AS (SELECT DISTINCT id AS item_id, term FROM terms WHERE side = 'i'),
        tfs AS (SELECT id AS doc_id, term, count(*) AS tf FROM terms WHERE side = 'd' GROUP BY id, term),
        sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
        totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
        damped AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // words AS m FROM sizes, totals),
        weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, totals GROUP BY term, docs),
        scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM items JOIN tfs USING (term) JOIN weights USING (term) JOIN damped USING (doc_id)
            GROUP BY item_id, doc_id),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
