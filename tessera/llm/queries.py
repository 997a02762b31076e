"""The registered queries opN_<name> of this subpackage, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, media, packing, paragraphs, passages, preferences, quality, simhash, token_counts, warc
from tessera.llm.common import table

#: Folder of the public tokenizers' files; TESSERA_TOKENIZERS names another.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "")


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_digests(table(spark, sf_dir, "documents"))


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.preference_segments(preferences.swapped_replies(table(spark, sf_dir, "conversations")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.capture_index(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_paragraphs, op2_simhash, op3_media, op4_best_fit_packing, op5_quality_rules, op6_token_counts, op7_suffix_array, op8_preferences, op9_warc, op10_bpe)}
SQL: dict[str, str] = {
    "op5_quality_rules": r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 7], ' ')) AS c FROM g),
again AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM n WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
d AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n_lines, 0) AS n_lines,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN again USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2, 10 * n_symbols > n_words AS f3, 2 * n_dup_lines > n_lines AS f4 FROM d),
u AS (SELECT 1 AS rule, source, count(*) AS n, count(*) FILTER (f1) AS k FROM f GROUP BY source UNION ALL SELECT 2, source, count(*), count(*) FILTER (f2) FROM f GROUP BY source
      UNION ALL SELECT 3, source, count(*), count(*) FILTER (f3) FROM f GROUP BY source UNION ALL SELECT 4, source, count(*), count(*) FILTER (f4) FROM f GROUP BY source),
m AS (SELECT rule, least(greatest(avg(k / n), 1e-6), 1 - 1e-6) AS mean, var_pop(k / n) AS spread, avg(n) AS size FROM u GROUP BY rule),
p AS (SELECT rule, mean, least(greatest(CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE size END, 1), greatest(size, 1)) AS weight FROM m),
r AS (SELECT source, rule, (k + mean * weight) / (n + weight) AS rate, greatest(0.5, least(0.9, mean + 3 * sqrt(mean * (1 - mean) / (weight + 1)))) AS most FROM u JOIN p USING (rule)),
v AS (SELECT source AS host, bool_or(rate >= most) AS bad, bool_or(rule = 3 AND rate >= 0.02) AS strict3, bool_or(rule = 4 AND rate >= 0.02) AS strict4 FROM r GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2 OR bad OR (f3 AND strict3) OR (f4 AND strict4)) AS kept
FROM f JOIN v ON host IS NOT DISTINCT FROM source
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS hex FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda k: CAST('0x' || substr(hex, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT)) AS parts FROM f)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((parts[i // 4 + 1] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
""",
    "op8_preferences": """
WITH t AS (
  SELECT conv_id AS pair_id, turn, min({'role': coalesce(role, ''), 'body': coalesce(text, '')}) AS r
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
last AS (SELECT pair_id, max(turn) AS last_turn, arg_max(r.body, turn) AS reply FROM t WHERE r.role = 'assistant' GROUP BY 1),
swap AS (SELECT a.pair_id, a.last_turn, b.reply AS other FROM last a JOIN last b ON b.pair_id = xor(a.pair_id, 1)),
sides AS (
  SELECT t.pair_id, t.turn, t.r.role AS role, t.r.body AS body, CASE WHEN t.turn = s.last_turn THEN s.other ELSE t.r.body END AS other
  FROM t LEFT JOIN swap s ON s.pair_id = t.pair_id),
first AS (SELECT pair_id, min(turn) FILTER (WHERE body <> other) AS f FROM sides GROUP BY 1),
seg AS (SELECT b.*, '<|im_start|>' || role || chr(10) AS head, '<|im_end|>' || chr(10) AS mark, f IS NOT NULL AND turn >= f AS done,
               f IS NOT NULL AND turn >= f AND role = 'assistant' AS learnt FROM sides b JOIN first USING (pair_id))
SELECT pair_id, CAST(turn AS BIGINT) AS seq, CASE WHEN NOT done THEN head || body || mark END AS prompt,
       CASE WHEN done THEN head || body || mark END AS chosen, CASE WHEN done THEN head || other || mark END AS rejected,
       CASE WHEN learnt THEN CAST(length(head) AS BIGINT) END AS chosen_from, CASE WHEN learnt THEN CAST(length(head) + length(body) + 10 AS BIGINT) END AS chosen_to,
       CASE WHEN learnt THEN CAST(length(head) AS BIGINT) END AS rejected_from, CASE WHEN learnt THEN CAST(length(head) + length(other) + 10 AS BIGINT) END AS rejected_to
FROM seg
""",
}
