"""Queries that mix, sample and split datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import mix
from corpusloom.plans.catalogue import query, table


def sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two tables of rows numbered from 0: documents and benchmark items."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.md5("text").alias("digest"))
    return [mix.numbered(d, "id"), mix.numbered(b, "id")]


SOURCES_SQL = """
a AS (SELECT doc_id AS id, md5(text) AS digest, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents),
b AS (SELECT item_id AS id, md5(text) AS digest, row_number() OVER (ORDER BY item_id) - 1 AS row_idx FROM benchmark)
"""


@query(f"WITH {SOURCES_SQL} SELECT 0 AS src_idx, * FROM a UNION ALL SELECT 1, * FROM b")
def mix_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.concatenated(*sources(spark, sf_dir))


_TURNS = """WITH {sources}, n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb),
r AS (SELECT unnest(range({pick}(na, nb)))::BIGINT AS r, na, nb FROM n)
SELECT 0 AS src_idx, r * 2 AS mix_idx, a.* FROM r JOIN a ON a.row_idx = r % na UNION ALL SELECT 1, r * 2 + 1, b.* FROM r JOIN b ON b.row_idx = r % nb"""


@query(_TURNS.format(sources=SOURCES_SQL, pick="least"))
def mix_interleave_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.interleaved(sources(spark, sf_dir), "interleave_under")


@query(_TURNS.format(sources=SOURCES_SQL, pick="greatest"))
def mix_interleave_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.interleaved(sources(spark, sf_dir), "interleave_over")


@query(f"""WITH {SOURCES_SQL}, n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb),
d AS (SELECT i AS mix_idx, (('0x' || left(md5('42-' || i), 12))::BIGINT / 281474976710656.0 >= 0.7)::INT AS src_idx, na, nb FROM n, LATERAL (SELECT unnest(range(na + nb)) AS i)),
t AS (SELECT *, row_number() OVER (PARTITION BY src_idx ORDER BY mix_idx) - 1 AS take FROM d),
k AS (SELECT * FROM t WHERE mix_idx < coalesce((SELECT min(mix_idx) FROM t WHERE take >= CASE src_idx WHEN 0 THEN na ELSE nb END), na + nb))
SELECT src_idx, mix_idx, s.id, s.digest, s.row_idx FROM k JOIN (SELECT 0 AS src_idx, * FROM a UNION ALL SELECT 1, * FROM b) s USING (src_idx) WHERE s.row_idx = k.take""")
def mix_interleave_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.interleaved(sources(spark, sf_dir), "interleave_under", [0.7, 0.3])


@query("""WITH d AS (SELECT item_id AS row_idx, md5(text) AS digest FROM benchmark), n AS (SELECT count(*) AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || row_idx), row_idx) - 1 AS sample_idx FROM d),
m AS (SELECT i AS sample_idx, ('0x' || left(md5('42-more-' || i), 15))::BIGINT % n AS pick FROM n, LATERAL (SELECT unnest(range(n, 500)) AS i))
SELECT row_idx, digest, sample_idx FROM p WHERE sample_idx < 500 UNION ALL SELECT d.row_idx, d.digest, m.sample_idx FROM m JOIN d ON d.row_idx = m.pick""")
def sample_with_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 rows of a smaller table: every row once, the rest drawn again."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_idx"), F.md5("text").alias("digest"))
    return mix.sampled(rows, 500, 42)


@query("""WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) - 1 AS k FROM documents)
SELECT doc_id AS row_idx, CASE WHEN k < ceil(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM r, n""")
def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.split(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx")), 0.1)


@query("SELECT doc_id AS row_idx, CASE WHEN doc_id < 25 THEN 'validation' ELSE 'train' END AS split FROM documents")
def split_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows validate, as on a stream."""
    return mix.split(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx")), 25, shuffle=False)


@query("SELECT doc_id AS row_idx FROM documents WHERE doc_id < 50")
def head_for_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.head_split(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx")), 50)[1]


@query("SELECT item_id AS row_idx, md5(text) AS digest FROM benchmark WHERE item_id < 20")
def max_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.first_rows(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_idx"), F.md5("text").alias("digest")), 20)
