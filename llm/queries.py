"""The registered queries of the operators: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (bloom_lm, bpe, chat_format, exact_dedup, fill_in_middle, fingerprints, mixing, near_dedup, pii,
               quality, resampling, simhash, toxicity)
from .common import table

TOKENIZER = "byte_bpe_50k.tiktoken"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, both of whose rows hold the template's control strings."""
    hard = spark.sql(r"SELECT bigint(-7) AS conv_id, bigint(turn) AS turn, role, '</s>[INST] ok [/INST]' AS text "
                     "FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat_format.digests(chat_format.format_conversations(rows))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.scores(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path(TOKENIZER),
                                public_tokenizers.PATTERN)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four words a shingle, as this query's contract says; the operator's own default is five."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=4)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.drawn_amounts(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four words a shingle, as this query's contract says; the operator's own default is five."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), n=4)


QUERIES = {f.__name__: f for f in (
    op1_chat_format, op2_fingerprints, op3_exact_dedup, op4_pii, op5_bloom_lm, op6_toxicity, op7_quality, op8_bpe,
    op9_near_dedup, op10_mixing, op11_resampling, op12_fill_in_middle, op13_simhash)}

ORACLE_SQL = {
    "op1_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(INST\]|/INST\]|/s>)', '\1\2\\\3', 'g') AS safe FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(role) + length(safe) + 22) AS BIGINT) AS formatted_chars,
               CAST(max(CASE WHEN safe = text THEN 1 ELSE 2 END) AS BIGINT) AS rounds
        FROM e GROUP BY conv_id""",
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g ON d.text = g.text""",
    "op11_resampling": r"""
        WITH crc_table AS (
            SELECT list_reduce([x, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry, x
            FROM (SELECT CAST(range AS BIGINT) AS x FROM range(256))),
        crc AS (SELECT list(entry ORDER BY x) AS t FROM crc_table),
        docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
        runs AS (
            SELECT row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM docs
            UNION ALL
            SELECT NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
        words AS (
            SELECT word, list_transform(range(1, CAST(length(hex(word)) / 2 AS BIGINT) + 1),
                       lambda i: 16 * (strpos('0123456789ABCDEF', hex(word)[2 * i - 1]) - 1) + strpos('0123456789ABCDEF', hex(word)[2 * i]) - 1) AS bytes
            FROM (SELECT DISTINCT word FROM runs)),
        buckets AS (
            SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
                       lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM words, crc),
        counts AS (
            SELECT bucket, count(row) AS s, count(*) - count(row) AS t FROM runs JOIN buckets USING (word) GROUP BY bucket),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / CAST((s + 1) * ((SELECT sum(t) FROM counts) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM counts),
        weights AS (
            SELECT row, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
            FROM runs JOIN buckets USING (word) JOIN gains USING (bucket) WHERE row IS NOT NULL GROUP BY row),
        scored AS (
            SELECT row, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
                       (CAST(concat('0x', substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
            FROM docs LEFT JOIN weights USING (row)),
        ranked AS (
            SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor(10 * n / 100) THEN place END AS rank
        FROM scored LEFT JOIN ranked USING (row)""",
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
                     list_transform([1, 9, 17, 25], lambda i: CAST(concat('0x', substr(h, i, 8)) AS BIGINT)) AS hs FROM d),
        c AS (SELECT *, CAST(len(lines) AS BIGINT) AS n, least(hs[1] % (len(lines) + 1), hs[2] % (len(lines) + 1)) AS a,
                     greatest(hs[1] % (len(lines) + 1), hs[2] % (len(lines) + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                          WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS pre, coalesce(array_to_string(lines[a + 1:b], ''), '') AS mid,
                     coalesce(array_to_string(lines[b + 1:], ''), '') AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
}
