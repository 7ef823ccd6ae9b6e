"""Whole preparations, from named datasets to encoded splits, a query per stage."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import DataArgs, DatasetSpec, RunSpec
from corpusloom.functions.tokens import valid_labels
from corpusloom.operators.align import gathered
from corpusloom.operators.prepare import prepare
from corpusloom.plans.catalogue import query, table
from corpusloom.plans.conversations import PAIR_SQL, PAIRED, PLAIN, TALK, TALK_SQL, TEXTS, pairs_by_source, tagged


#: Which rows of the CTE ``e`` validate: the first of a seeded order.
def _splits(share: str) -> str:
    return f"""k AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || row_idx), row_idx) AS rank, {share} AS take FROM e)"""


SPLIT = "CASE WHEN rank <= take THEN 'validation' ELSE 'train' END AS split"
#: How many tokens of a prompt of s and an answer of t fit into a budget.
NEW_T = "least({t}, CASE WHEN {t} * 2 < {cut} THEN {cut} WHEN s * 2 < {cut} THEN {cut} - s ELSE trunc({cut} * ({t}::DOUBLE / (s + {t})))::BIGINT END)"
PLAINTEXT = DatasetSpec("texts", columns={"prompt": "text"})


@query(f"""WITH d AS (SELECT doc_id AS i, text FROM documents UNION ALL SELECT (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY item_id) - 1, text FROM benchmark),
v AS (SELECT i, i // 1000 AS b, list_append(list_transform(regexp_extract_all(text, '\\S+'), lambda x: ('0x' || left(md5(x), 7))::INT), 2) AS ids FROM d),
p AS (SELECT b, ids, coalesce(sum(len(ids)) OVER (PARTITION BY b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM v),
t AS (SELECT b, ahead + g.i - 1 AS pos, ids[g.i] AS id FROM p, LATERAL (SELECT unnest(range(1, len(ids) + 1)) AS i) g),
e AS (SELECT (b * 4294967296 + pos // 128)::BIGINT AS row_idx, sum(id)::BIGINT AS total, min_by(id, pos) AS first_id FROM t GROUP BY b, pos // 128 HAVING count(*) = 128),
{_splits("(SELECT ceil(count(*) * 0.1) FROM e)")}
SELECT row_idx, total, first_id, {SPLIT} FROM k""")
def prepare_pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corpora end to end, packed into blocks; a tenth of the blocks validates."""
    both = {
        "documents": (replace(PLAINTEXT, name="documents"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "text")),
        "benchmark": (replace(PLAINTEXT, name="benchmark"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_idx"), "text")),
    }
    module = prepare(spark, RunSpec("pt"), DataArgs(cutoff_len=128, val_size=0.1, datasets=tuple(both)), tables=both)
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return module.marked.select("row_idx", total.alias("total"), F.element_at("input_ids", 1).alias("first_id"), "split")


CUT, DRAWN = 96, 300


@query(f"""WITH RECURSIVE {TALK_SQL},
n AS (SELECT count(*) AS n FROM led), o AS (SELECT conv_id, row_number() OVER (ORDER BY md5('42-' || conv_id), conv_id) - 1 AS pl FROM led),
again AS (SELECT i AS pl, ('0x' || left(md5('42-more-' || i), 15))::BIGINT % n AS conv_id FROM n, LATERAL (SELECT unnest(range(n, {DRAWN})) AS i)),
drawn AS (SELECT conv_id, pl FROM o WHERE pl < {DRAWN} UNION ALL SELECT conv_id, pl FROM again),
r AS (SELECT pl AS i, i // 2 AS r, max(k) FILTER (i % 2 = 0) AS s, max(k) FILTER (i % 2 = 1) AS t FROM lens JOIN drawn USING (conv_id) GROUP BY ALL
  UNION ALL SELECT {DRAWN} + doc_id, 0, len(regexp_extract_all('Human: ' || split_part(text, chr(10), 1) || '</s>' || chr(10) || 'Assistant:', '\\S+')),
    len(regexp_extract_all(substr(text, length(split_part(text, chr(10), 1)) + 2) || '</s>' || chr(10), '\\S+')) FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
fold AS (SELECT i, 0::BIGINT AS r, 0::BIGINT AS used, 0::BIGINT AS kept FROM (SELECT DISTINCT i FROM r)
  UNION ALL SELECT i, r + 1, used + ns + nt, kept + nt FROM (
    SELECT i, r, used, kept, nt, least(greatest({CUT} - used - nt, 0), s) AS ns FROM (
      SELECT f.*, s, {NEW_T.format(t="t", cut=f"({CUT} - used)")} AS nt FROM fold f JOIN r ON f.i = r.i AND f.r = r.r WHERE used < {CUT}) f)),
e AS (SELECT i AS row_idx, max(used) AS n_ids, max(kept) AS n_labels FROM fold GROUP BY i),
{_splits("50")}
SELECT row_idx, n_ids, n_labels, {SPLIT} FROM k""")
def prepare_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of conversations, drawn again where there are too few, then instruction rows; 50 validate."""
    talks = gathered(table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumnRenamed("conv_id", "row_idx")
    both = {"talk": (replace(TALK, name="talk", num_samples=DRAWN), talks), "texts": (replace(TEXTS, name="texts", columns={"prompt": "instruction", "response": "output"}), tagged(spark, sf_dir))}
    module = prepare(spark, RunSpec("sft"), DataArgs(cutoff_len=CUT, val_size=50, datasets=tuple(both)), tables=both, extras=PLAIN)
    return module.marked.select("row_idx", F.size("input_ids").cast("long").alias("n_ids"), F.size(valid_labels(F.col("labels"))).cast("long").alias("n_labels"), "split")


@query(f"""WITH {PAIR_SQL}, m AS (SELECT doc_id, s, c, j, greatest(c, j) AS t FROM z),
e AS (SELECT doc_id AS row_idx, c, j, s, {NEW_T.format(t="t", cut=128)} AS nt FROM m),
{_splits("(SELECT ceil(count(*) * 0.25) FROM e)")}
SELECT row_idx, (least(greatest(128 - nt, 0), s) + least(c, nt))::INT AS n_chosen, (least(greatest(128 - nt, 0), s) + least(j, nt))::INT AS n_rejected, {SPLIT} FROM k""")
def prepare_rm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked pairs; a quarter validates."""
    pairs = {"pairs": (PAIRED, pairs_by_source(spark, sf_dir))}
    module = prepare(spark, RunSpec("rm", template="ext_pair"), DataArgs(cutoff_len=128, val_size=0.25, datasets=("pairs",)), tables=pairs, extras=PLAIN)
    return module.marked.select("row_idx", F.size("chosen_input_ids").alias("n_chosen"), F.size("rejected_input_ids").alias("n_rejected"), "split")


KTO_CUT = 256


@query(f"""WITH x AS (SELECT doc_id, quality = 1 AS good, doc_id // 1000 AS b, split_part(text, chr(10), 1) AS ask, substr(text, length(split_part(text, chr(10), 1)) + 2) AS answer FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
y AS (SELECT doc_id, good AND answer <> '' AS kto_tags, len(regexp_extract_all('<|im_start|>system' || chr(10) || 'You are Qwen, created by Alibaba Cloud. You are a helpful assistant.<|im_end|>' || chr(10)
  || '<|im_start|>user' || chr(10) || ask || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10), '\\S+')) AS s, len(regexp_extract_all(answer || '<|im_end|>' || chr(10), '\\S+')) AS own, b FROM x),
z AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY b ORDER BY doc_id), last_value(own) OVER (PARTITION BY b ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS kl FROM y),
c AS (SELECT doc_id, kto_tags, s, {NEW_T.format(t="own", cut=KTO_CUT)} AS nt,
  {NEW_T.format(t="kl", cut=KTO_CUT)} AS kt FROM z),
e AS (SELECT doc_id AS row_idx, kto_tags, (least(greatest({KTO_CUT} - nt, 0), s) + nt)::INT AS n_ids, nt::INT AS n_labels, (least(greatest({KTO_CUT} - kt, 0), s) + kt)::INT AS n_kl_ids FROM c),
{_splits("(SELECT ceil(count(*) * 0.1) FROM e)")}
SELECT row_idx, kto_tags, n_ids, n_labels, n_kl_ids, {SPLIT} FROM k""")
def prepare_kto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a preference, each beside the answer of the row before it; a tenth validates."""
    rows = {"tagged": (TEXTS, tagged(spark, sf_dir))}
    module = prepare(spark, RunSpec("kto", template="qwen"), DataArgs(cutoff_len=KTO_CUT, val_size=0.1, datasets=("tagged",)), tables=rows, extras=PLAIN)
    return module.marked.select("row_idx", "kto_tags", F.size("input_ids").alias("n_ids"), F.size(valid_labels(F.col("labels"))).alias("n_labels"), F.size("kl_input_ids").alias("n_kl_ids"), "split")
