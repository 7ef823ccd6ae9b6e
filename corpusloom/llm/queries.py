"""One query per operator of this subpackage, over its whole table, and the SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, crosstok, langid, license_scan, line_dedup, lm, packing, quality, resampling, sharding, simhash, warc

WORD = r"[^\x20\x09-\x0D]+"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_records(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_docs(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_docs(spark, sf_dir), exact=True)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing(_docs(spark, sf_dir))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dedup(_docs(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scoring(_docs(spark, sf_dir))


def op8_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_fingerprints(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_docs(spark, sf_dir))


def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encoding(_docs(spark, sf_dir))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.cross_tokenizer_alignment(_docs(spark, sf_dir))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding(_docs(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resampling(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""

OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w, string_split(t, chr(10)) AS l FROM d),
wins AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS k FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM base)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM wins) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n_repeat FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
lines AS (SELECT r, j, l[j] AS s, len(regexp_extract_all(l[j], '{WORD}')) AS n FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS j FROM base)),
own AS (SELECT *, row_number() OVER (PARTITION BY r, s ORDER BY j) > 1 AS dup,
  length(regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
  length(regexp_replace(s, '[^|]', '', 'g')) AS bars, length(regexp_replace(s, '[^#*$%&<>]', '', 'g')) AS sym,
  length(regexp_replace(s, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(s, '[^a-z]', '', 'g')) AS low
  FROM lines WHERE n > 0),
judged AS (SELECT *, (bars >= 2 AND 4 * bars >= n) OR 2 * sym >= n OR (n >= 2 AND up > low)
  OR (n <= 20 AND regexp_matches(s, '(?i){"|".join(quality.BOILERPLATE)}'))
  OR NOT regexp_matches(s, '[.!?:;…"'')\]”’»。！？：；」』）｡।॥۔؟؛։።][\x20\x09-\x0D]*$') AS fails FROM own),
doc_lines AS (SELECT r, count(*) FILTER (dup) AS n_dup, count(*) FILTER (fails) AS n_fail, coalesce(sum(chars) FILTER (fails), 0) AS lost FROM judged GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(n_fail, 0)::BIGINT AS n_failed_lines, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM base LEFT JOIN rep USING (r) LEFT JOIN doc_lines USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 40 * word_chars AS kept, n_failed_lines, lost_chars
FROM m
"""

#: The CRC's table of 256 values, and the CRC of a text's UTF-8.
CRC_TABLE = """tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM (SELECT i,
  list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)))"""
CRC_OF = """xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""

OP12_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 1 AS size, left(md5(coalesce(text, '')), 16) AS grp, left(md5(coalesce(doc_id::VARCHAR, '')), 16) AS own FROM documents),
s AS (SELECT sum(size)::HUGEINT AS total FROM d),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY grp, own ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(size) OVER (PARTITION BY grp) AS grp_size FROM d),
g AS (SELECT *, min(start) OVER (PARTITION BY grp) AS grp_start FROM p),
h AS (SELECT *, least(15, (CASE WHEN grp_size * 1024 <= total THEN 2 * grp_start + grp_size ELSE 2 * start + size END) * 16 // (2 * total)) AS sh FROM g, s)
SELECT doc_id, size::BIGINT AS size, {CRC_OF.format("t")}::BIGINT AS text_crc32, 'bytes' AS law, sh::INTEGER AS shard,
  row_number() OVER (PARTITION BY sh ORDER BY grp, own) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM h, tab
"""

OP13_SQL = rf"""
WITH {CRC_TABLE},
texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM words),
counted AS (SELECT side, r, g, count(*) AS n FROM grams GROUP BY ALL),
placed AS (SELECT g, {CRC_OF.format("g")} % 10000 AS b FROM (SELECT DISTINCT g FROM counted), tab),
sums AS (SELECT b, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM counted JOIN placed USING (g) GROUP BY b),
alls AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gain AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, alls),
weights AS (SELECT r, sum(n) AS nf, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM counted JOIN placed USING (g) JOIN gain USING (b) WHERE side = 0 GROUP BY r),
scored AS (SELECT doc_id, len(w) AS nw, coalesce(nf, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM (SELECT * FROM words WHERE side = 0) LEFT JOIN weights USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY nw >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY nw >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN nw >= 20 AND k <= 25 * n // 100 THEN k END AS rank FROM ranked
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_warc, op2_license_scan, op3_language_id, op4_line_dedup, op5_packing,
        op6_simhash_near_dedup, op7_lm_scoring, op8_media_fingerprints, op9_quality_rules, op10_bpe_encoding,
        op11_cross_tokenizer_alignment, op12_sharding, op13_importance_resampling,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op9_quality_rules": OP9_SQL, "op12_sharding": OP12_SQL, "op13_importance_resampling": OP13_SQL}
