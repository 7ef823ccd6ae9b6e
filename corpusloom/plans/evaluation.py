"""Queries that score, smooth and count: evaluation, statistics, extensions on the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import media, unigram
from corpusloom.functions.tokens import ignored, joined, masked_prompt_labels, prefix_token_types, whitespace_words, within, without
from corpusloom.functions.tokens import tokenizer as tokenizer_of
from corpusloom.operators import evaluate, stats
from corpusloom.operators.mix import random_key
from corpusloom.plans.catalogue import query, table


def cents(c: Column | str, digits: int = 6) -> Column:
    """Rounded, so that two engines agree on the last digits of a sum."""
    return F.round(c, digits)


@query("""SELECT coalesce(lang, 'Average') AS category, count(*) AS n, round(avg(quality) * 100, 6) AS accuracy FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY GROUPING SETS ((lang), ())""")
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").filter("quality is not null")
    return evaluate.category_accuracy(rows, "lang", "quality").withColumn("accuracy", cents("accuracy"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: predicted and true classes of its lines, the first of them ignored."""
    line = F.struct("l_linenumber", (F.col("l_partkey") % 3).cast("int").alias("p"), F.when(F.col("l_linenumber") % 4 == 1, -100).otherwise(F.col("l_suppkey") % 3).cast("int").alias("t"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("s"))
    return rows.select("l_orderkey", F.transform("s", lambda x: x["p"]).alias("pred"), F.transform("s", lambda x: x["t"]).alias("labels"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS p, CASE WHEN l_linenumber % 4 = 1 THEN -100 ELSE l_suppkey % 3 END AS t,
  lag(l_partkey % 3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 3, CASE WHEN l_linenumber % 4 = 1 THEN -100 ELSE l_suppkey % 3 END) AS before FROM lineitem)
SELECT l_orderkey, count(*) FILTER (before IS NOT NULL AND t <> -100) AS n, round(avg((before = t)::INT) FILTER (before IS NOT NULL AND t <> -100), 6) AS accuracy FROM x GROUP BY l_orderkey""")
def masked_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _series(spark, sf_dir)
    accuracy = evaluate.token_accuracy(F.col("pred"), F.col("labels"))
    n = F.size(F.filter(F.slice("labels", F.lit(2), F.greatest(F.size("labels") - 1, F.lit(0))), lambda t: t != -100))
    return rows.select("l_orderkey", n.cast("long").alias("n"), cents(F.when(~F.isnan(accuracy), accuracy)).alias("accuracy"))


@query("SELECT round(avg((l_extendedprice > l_quantity * 1000)::INT), 9) AS accuracy FROM lineitem")
def reward_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("c"), (F.col("l_quantity") * 1000).alias("r"))
    return evaluate.reward_accuracy(rows, "c", "r").withColumn("accuracy", cents("accuracy", 9))


@query("""SELECT round(avg(l_discount), 6) AS rewards_chosen, round(avg(l_tax), 6) AS rewards_rejected, round(avg((l_discount > l_tax)::INT), 6) AS rewards_accuracies, round(avg(l_discount - l_tax), 6) AS rewards_margins FROM lineitem""")
def preference_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.preference_metrics(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax")
    return out.select(*(cents(c).alias(c) for c in out.columns))


@query("""WITH r AS (SELECT quality = 1 AS tag, n_chars * 1.0 AS reward FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
m AS (SELECT sum(reward) FILTER (tag) AS cs, count(*) FILTER (tag) AS cc, sum(reward) FILTER (NOT tag) AS rs, count(*) FILTER (NOT tag) AS rc FROM r)
SELECT cs::DOUBLE AS chosen_sum, cc AS chosen_count, rs::DOUBLE AS rejected_sum, rc AS rejected_count, round((cs / cc)::DOUBLE, 6) AS chosen_mean, round((rs / rc)::DOUBLE, 6) AS rejected_mean, round((cs / cc - rs / rc)::DOUBLE, 6) AS margin FROM m""")
def kto_class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").filter("quality is not null")
    out = evaluate.class_means(rows.select((F.col("quality") == 1).alias("tag"), F.col("n_chars").cast("double").alias("reward")), "reward", "tag")
    return out.withColumns({c: cents(c) for c in ("chosen_mean", "rejected_mean", "margin")})


@query("""WITH p AS (SELECT l_orderkey, exp(sum(l_discount * (l_linenumber > 1)::INT) / nullif(sum((l_linenumber > 1)::INT), 0)) AS ppl FROM lineitem GROUP BY 1) SELECT round(avg(ppl), 9) AS perplexity FROM p""")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("mask", F.when(F.col("l_linenumber") > 1, 1).otherwise(0))
    counted = rows.join(rows.groupBy("l_orderkey").agg(F.sum("mask").alias("k")).filter("k > 0"), "l_orderkey", "left_semi")
    return evaluate.macro_mean(evaluate.perplexity(counted, "l_orderkey", "l_discount", "mask"), "perplexity").withColumn("perplexity", cents("perplexity", 9))


@query("""SELECT l_orderkey, l_linenumber, round(-c + 0.1 * ln(1 + exp(-((c - r) - (ln(1 - exp(c)) - ln(1 - exp(r)))))), 9) AS odds, round(ln(1 + exp(-2.0 * (c - r - 0.5 / 2.0))), 9) AS margin, round(0.1 * (c - r), 9) AS reward
FROM (SELECT l_orderkey, l_linenumber, -l_discount - 0.5 AS c, -l_tax - 0.7 AS r FROM lineitem)""")
def preference_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = -F.col("l_discount") - 0.5, -F.col("l_tax") - 0.7
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", cents(evaluate.odds_ratio_loss(c, r, 0.1), 9).alias("odds"),
        cents(evaluate.margin_loss(c, r, 2.0, 0.5), 9).alias("margin"), cents(evaluate.reward(c, r, 0.1), 9).alias("reward"),
    )


@query("""WITH x AS (SELECT l_orderkey, CASE WHEN l_linenumber % 4 = 1 THEN -100 ELSE l_suppkey % 3 END AS t, l_linenumber, l_partkey % 3 AS p FROM lineitem),
y AS (SELECT *, lag(-p / 10.0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p, t) AS before FROM x)
SELECT l_orderkey, round(coalesce(sum(before) FILTER (t <> -100), 0), 6)::DOUBLE AS logp, count(before) FILTER (t <> -100)::INT AS n FROM y GROUP BY 1""")
def sequence_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _series(spark, sf_dir)
    logp, n = evaluate.sequence_logps(F.transform("pred", lambda p: -p / 10.0), F.col("labels"))
    return rows.select("l_orderkey", cents(logp).alias("logp"), n.alias("n"))


@query("""SELECT vec_id, chr((64 + list_position(embedding[1:4], list_max(embedding[1:4])))::INT) AS letter FROM embeddings""")
def score_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", evaluate.choice(F.slice("embedding", 1, 4)).alias("letter"))


@query("""WITH e AS (SELECT label, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) g(i)) SELECT label, i::INT - 1 AS i, round(avg(v), 6) AS v FROM e GROUP BY 1, 2""")
def embedding_mean_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New tokens (labels) start as the mean of the vectors of the tokens that describe them."""
    vectors = table(spark, sf_dir, "embeddings")
    tokens = vectors.groupBy("label").agg(F.collect_list("vec_id").alias("ids"))
    out = stats.mean_embedding(tokens, vectors, "label", "ids", "vec_id", "embedding")
    return out.select("label", F.posexplode("embedding").alias("i", "v")).withColumn("v", cents("v"))


@query()
def embedding_noisy_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.noisy_mean(table(spark, sf_dir, "embeddings"), "embedding", 42)


@query("""WITH RECURSIVE s AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL AND value <> 0),
w AS (SELECT *, 1.8 * (1 / (1 + exp(-0.05 * n)) - 0.5) AS w FROM s),
f AS (SELECT event_type, event_id, k, value * w + (1 - w) * value AS smoothed FROM w WHERE k = 1
  UNION ALL SELECT w.event_type, w.event_id, w.k, f.smoothed * w.w + (1 - w.w) * w.value FROM f JOIN w ON w.event_type = f.event_type AND w.k = f.k + 1)
SELECT event_type, event_id, round(smoothed, 6) AS smoothed FROM f""")
def loss_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type, the events as a training log."""
    log = stats.loss_rows(table(spark, sf_dir, "events"), "value")
    return stats.smoothed(log, "event_type", "event_id", "value").select("event_type", "event_id", cents("smoothed").alias("smoothed"))


@query("""WITH l AS (SELECT event_id, event_id + 1 AS done, event_id + 1000 AS total, event_id * 7 AS elapsed FROM events), r AS (SELECT *, round(done / total * 100, 2) AS percentage, CAST(trunc(elapsed / done * (total - done)) AS BIGINT) AS remain FROM l)
SELECT event_id, percentage, (CASE WHEN elapsed >= 86400 THEN (elapsed // 86400) || CASE elapsed // 86400 WHEN 1 THEN ' day, ' ELSE ' days, ' END ELSE '' END) || (elapsed % 86400 // 3600) || ':' || lpad((elapsed % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((elapsed % 60)::VARCHAR, 2, '0') AS elapsed_time,
 (CASE WHEN remain >= 86400 THEN (remain // 86400) || CASE remain // 86400 WHEN 1 THEN ' day, ' ELSE ' days, ' END ELSE '' END) || (remain % 86400 // 3600) || ':' || lpad((remain % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((remain % 60)::VARCHAR, 2, '0') AS remaining_time FROM r""")
def training_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") + 1).alias("done"), (F.col("event_id") + 1000).alias("total"), (F.col("event_id") * 7).alias("elapsed"))
    return stats.progress(log, "done", "total", "elapsed").select("event_id", "percentage", "elapsed_time", "remaining_time")


@query("""SELECT user_id, event_id, round(sum(value) OVER w, 6) AS sum, count(value) OVER w AS count, round(avg(value) OVER w, 9) AS avg FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.running(table(spark, sf_dir, "events"), "event_id", "value", "user_id")
    return out.select("user_id", "event_id", cents("sum").alias("sum"), "count", cents("avg", 9).alias("avg"))


@query("""SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 1""")
def last_log_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.sources.catalog import last_log

    return last_log(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")


@query("""SELECT round(sum(len(regexp_extract_all(text, '\\S+'))) * 3.0 / 60 / 8, 6) AS tokens_per_second FROM documents""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.functions.tokens import tokenizer

    rows = table(spark, sf_dir, "documents").select(tokenizer("whitespace")(F.col("text")).alias("ids"))
    return stats.throughput(rows, "ids", 3.0, 60.0, 8).withColumn("tokens_per_second", cents("tokens_per_second"))


@query("""WITH s AS (SELECT p_partkey, (p_size * 64)::DOUBLE AS n FROM part),
f AS (SELECT p_partkey, 8 * n * 32 * 3 * 2 * 4096.0 * 11008.0 AS mlp, 8 * n * 32 * (2 * 2 * 4096.0 * 4096.0 + 2 * (2 * 4096.0 * 4096.0 * 8 / 32)) AS proj,
  8 * 32 * (2 * 2 * 4096.0 * n * n) AS sdpa, 8 * n * 4096.0 * 32000.0 * 2 AS emb FROM s)
SELECT p_partkey, round(3 * (mlp + proj + sdpa) + 3 * emb, 0) / 1e12 AS train_tflops, round(4 * (mlp + proj + sdpa) + 3 * emb + sdpa, 0) / 1e12 AS recompute_tflops,
  round(mlp + proj + sdpa + emb / 2, 0) / 1e12 AS forward_tied_tflops FROM f""")
def analytic_flops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") * 64
    flops = lambda **how: F.round(stats.transformer_flops(32, 4096, 11008, 32000, n, kv_share=0.25, batch=8, **how), 0) / 1e12
    return table(spark, sf_dir, "part").select(
        "p_partkey", flops().alias("train_tflops"), flops(recompute=True, flash=True).alias("recompute_tflops"), flops(backward=False, tied=True).alias("forward_tied_tflops")
    )


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    answer = F.chr(F.lit(65) + F.col("item_id") % 4)
    return items.select("item_id", F.concat(F.lit("subject "), (F.col("item_id") % 3).cast("string")).alias("subject"), F.col("text").alias("question"), *(F.concat(F.lit(f"{c}-"), F.col("item_id").cast("string")).alias(c) for c in "ABCD"), answer.alias("answer"))


@query("""WITH q AS (SELECT item_id, 'subject ' || (item_id % 3) AS subject, text || chr(10) || 'A. A-' || item_id || chr(10) || 'B. B-' || item_id || chr(10) || 'C. C-' || item_id || chr(10) || 'D. D-' || item_id || chr(10) || 'Answer:' AS ask, chr((65 + item_id % 4)::INT) AS answer FROM benchmark),
d AS (SELECT t.item_id, s.ask, s.answer, row_number() OVER (PARTITION BY t.item_id ORDER BY md5('42-' || t.item_id || '-' || s.item_id)) AS r FROM q t JOIN q s ON t.subject = s.subject AND t.item_id >= 9 AND s.item_id < 9),
h AS (SELECT item_id, string_agg('user:' || ask || '|assistant:' || answer, '|' ORDER BY r) AS shots FROM d WHERE r <= 2 GROUP BY 1)
SELECT item_id, md5('user:The following are multiple choice questions (with answers) about ' || subject || '.' || chr(10) || chr(10) || substr(shots || '|user:' || ask, 6)) AS digest, answer AS label FROM q JOIN h USING (item_id)""")
def few_shot_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _questions(spark, sf_dir)
    out = evaluate.few_shot(rows.filter("item_id >= 9"), rows.filter("item_id < 9"), 2)
    shown = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return out.select("item_id", F.md5(shown).alias("digest"), "label")


@query()
def bleu_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's whole text as a prediction of the benchmark item of its number."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("predict"))
    rows = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "label").join(d, "item_id")
    return evaluate.overlap_scores(rows).drop("predict", "label")


@query()
def bleu_rouge_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_mean(bleu_rouge(spark, sf_dir), "bleu_4", "rouge_1", "rouge_2", "rouge_l")


# --- beyond the reference's vocabulary, on the star schema --------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY md5(text)")
def ext_dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("k")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def ext_hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy(hour.alias("start"), "event_type").agg(F.count("*").alias("n"), cents(F.sum("value"), 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes', true)::INT AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def ext_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(w) >= F.expr("INTERVAL '30' MINUTE")
    marked = table(spark, sf_dir, "events").select("user_id", "ts", F.coalesce(gap, F.lit(True)).cast("int").alias("new"))
    numbered = marked.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("session")


@query("""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, n_name)""")
def ext_revenue_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda n: table(spark, sf_dir, n)
    rows = get("lineitem").join(get("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(get("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(get("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(get("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.cube("r_name", "n_name").agg(cents(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def seeded_order(seed: int, *columns: str) -> Column:
    return random_key(seed, *columns)


@query("""WITH x AS (SELECT quality = 1 AS good, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars / 100.0 END AS r, doc_id * 0.5 AS p FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
SELECT round(sum(r) FILTER (good) / count(*) FILTER (good), 6) AS rewards_chosen, round(sum(r) FILTER (NOT good) / count(*) FILTER (NOT good), 6) AS rewards_rejected,
  round(avg(p) FILTER (good), 6) AS logps_chosen, round(avg(p) FILTER (NOT good), 6) AS logps_rejected, round(avg(p), 6) AS kl,
  round(sum(r) FILTER (good) / count(*) FILTER (good) - sum(r) FILTER (NOT good) / count(*) FILTER (NOT good), 6) AS rewards_margins FROM x""")
def kto_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a preference run: a reward in seven is not a number."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").filter("quality is not null")
    scored = rows.select((F.col("quality") == 1).alias("tag"), F.when(F.col("doc_id") % 7 == 0, float("nan")).otherwise(F.col("n_chars") / 100.0).alias("rewards"), (F.col("doc_id") * 0.5).alias("logps"))
    out = evaluate.feedback_metrics(scored, "tag", ("rewards", "logps"), kl="logps")
    return out.select(*(cents(c).alias(c) for c in out.columns))


@query("SELECT round(avg(l_discount), 9) AS rewards_chosen, round(avg(l_tax), 9) AS rewards_rejected, round(avg((l_discount > l_tax)::INT), 9) AS rewards_accuracies, round(avg(l_discount - l_tax), 9) AS rewards_margins, round(avg(l_quantity), 9) AS logps_chosen, round(avg(l_linenumber), 9) AS logps_rejected, round(avg(l_tax), 9) AS sft_loss, round(avg((l_discount - l_tax) / 0.1), 9) AS odds_ratio_loss FROM lineitem")
def preference_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({"chosen_logps": F.col("l_quantity"), "rejected_logps": F.col("l_linenumber")})
    out = evaluate.preference_metrics(rows, "l_discount", "l_tax", ("logps",), "l_tax", "l_discount")
    return out.select(*(cents(c, 9).alias(c) for c in out.columns))


@query("SELECT doc_id AS row_idx, md5(text) AS prompt, lang AS predict, source AS label FROM documents")
def predictions_zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts, predictions and labels from tables of their own, side by side by place."""
    rows = table(spark, sf_dir, "documents").withColumn("row_idx", F.col("doc_id"))
    return evaluate.zipped(prompt=rows.select("row_idx", F.md5("text").alias("p")), predict=rows.select("row_idx", "lang"), label=rows.select("row_idx", "source"))


@query("""WITH w AS (SELECT conv_id, list(DISTINCT w) FILTER (role = 'user') AS a, list(DISTINCT w) FILTER (role = 'assistant') AS b FROM (SELECT conv_id, role, unnest(regexp_extract_all(text, '\\S+')) AS w FROM conversations) GROUP BY conv_id)
SELECT conv_id, len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS only_asked, len(list_distinct(list_concat(a, b)))::BIGINT AS either, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS inside FROM w WHERE a IS NOT NULL AND b IS NOT NULL""")
def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, words of the questions against those of the answers."""
    words = lambda role: F.flatten(F.collect_list(F.when(F.col("role") == role, whitespace_words(F.col("text")))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(words("user").alias("a"), words("assistant").alias("b")).filter("size(a) > 0 and size(b) > 0")
    return rows.select("conv_id", F.size(without(F.col("a"), F.col("b"))).cast("long").alias("only_asked"), F.size(joined(F.col("a"), F.col("b"))).cast("long").alias("either"), within(F.col("a"), F.col("b")).alias("inside"))


@query("SELECT doc_id AS row_idx, source AS prompt, lang AS predict, text AS label FROM documents")
def predictions_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of prompts, predictions and labels (their front ignored) back to texts."""
    import public_tokenizers

    tok = unigram.of_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), tok(F.col("source")).alias("prompt_ids"), tok(F.col("lang")).alias("predict_ids"), tok(F.col("text")).alias("__text"))
    rows = rows.withColumn("label_ids", F.concat(ignored(F.size("prompt_ids")), F.col("__text"))).drop("__text")
    return evaluate.decoded_predictions(rows, tok)


@query("""WITH x AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n, doc_id % 40 AS k FROM documents)
SELECT doc_id, least(k, n)::INT AS n_ignored, (n - least(k, n))::INT AS n_valid, n::INT AS n_front FROM x""")
def prompt_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose first tokens, as many as a prompt has, are ignored, and token types behind images in front."""
    ids = tokenizer_of("whitespace")(F.col("text"))
    labels = masked_prompt_labels(F.col("ids"), (F.col("doc_id") % 40).cast("int"))
    types = prefix_token_types(F.lit(2), 3, F.size("ids") + 6)
    rows = table(spark, sf_dir, "documents").withColumn("ids", ids).select("doc_id", labels.alias("l"), types.alias("t"))
    count = lambda c, v: F.size(F.filter(c, lambda x: x == v))
    return rows.select("doc_id", count("l", -100).alias("n_ignored"), (F.size("l") - count("l", -100)).alias("n_valid"), count("t", 1).alias("n_front"))


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity * 1e12) / (l_linenumber * 2.0) / (312.0 * 1e12 * 8), 12) AS used FROM lineitem""")
def device_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = stats.utilisation(F.col("l_quantity") * 1e12, F.col("l_linenumber") * 2.0, 312.0, 8)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cents(used, 12).alias("used"))


@query("""WITH s AS (SELECT p_partkey, p_size * 30 + 20 AS h, p_size * 17 + 40 AS w FROM part),
r AS (SELECT *, greatest(28, (round_even(h / 28.0, 0) * 28)::INT) AS h0, greatest(28, (round_even(w / 28.0, 0) * 28)::INT) AS w0, sqrt(h * w / 589824.0::DOUBLE) AS shrink, sqrt(1024.0::DOUBLE / (h * w)) AS grow FROM s),
g AS (SELECT *, CASE WHEN h0 * w0 > 589824 THEN greatest(28, (floor(h / shrink / 28) * 28)::INT) WHEN h0 * w0 < 1024 THEN greatest(28, (ceil(h * grow / 28) * 28)::INT) ELSE h0 END AS h1,
  CASE WHEN h0 * w0 > 589824 THEN greatest(28, (floor(w / shrink / 28) * 28)::INT) WHEN h0 * w0 < 1024 THEN greatest(28, (ceil(w * grow / 28) * 28)::INT) ELSE w0 END AS w1 FROM r)
SELECT p_partkey, ((h // 14) * (w // 14) - 1)::INT AS flat, ((h1 // 14) * (w1 // 14) // 4)::INT AS merged, (ceil((p_partkey % 9 + 1) / 2.0)::INT * (h1 // 14) * (w1 // 14) // 4)::INT AS video,
  ((h // 14) * (w // 14))::INT AS places FROM g""")
def media_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of pictures and videos by their sizes, as several models count them."""
    size = F.array(F.struct((F.col("p_size") * 30 + 20).alias("height"), (F.col("p_size") * 17 + 40).alias("width"), (F.col("p_partkey") % 9 + 1).cast("int").alias("frames")))
    of = lambda name, kind, g=media.Geometry(): F.get(media.counts(name, kind, size, g), F.lit(0))
    grid = of("pixtral", "image")
    return table(spark, sf_dir, "part").select(
        "p_partkey", of("llava", "image", media.Geometry(drop_first=True)).alias("flat"), of("qwen2_vl", "image").alias("merged"), of("qwen2_vl", "video").alias("video"), (grid["rows"] * grid["columns"]).alias("places"),
    )


@query("""SELECT coalesce(r_name, 'Average') AS category, count(*) AS n, round(avg((c_acctbal > 0)::INT) * 100, 6) AS accuracy FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), ())""")
def accuracy_by_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category of the subjects, which a table tells: customers by the region of their nation."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    subjects = nations.select(F.col("n_nationkey").alias("subject"), F.col("r_name").alias("category"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("subject"), (F.col("c_acctbal") > 0).alias("right"))
    return evaluate.category_accuracy(evaluate.categorised(rows, subjects), "category", "right").withColumn("accuracy", cents("accuracy"))


@query("""WITH w AS (SELECT label AS token, unnest([vec_id, vec_id, vec_id % 7]) AS token_id FROM embeddings WHERE vec_id % 3 = 0), v AS (SELECT vec_id AS token_id, embedding FROM embeddings)
SELECT token, i::INT - 1 AS i, round(avg(embedding[i]::DOUBLE), 6) AS v FROM w JOIN v USING (token_id), range(1, 65) g(i) GROUP BY 1, 2""")
def described_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New tokens (labels) told by lists of known ones; their words count as often as they stand there."""
    vectors = table(spark, sf_dir, "embeddings")
    told = vectors.filter("vec_id % 3 = 0").groupBy("label").agg(F.flatten(F.collect_list(F.array("vec_id", "vec_id", F.col("vec_id") % 7))).alias("description"))
    out = stats.described_embedding(vectors.select(F.col("label").alias("token")).distinct(), told.withColumnRenamed("label", "token"), vectors.withColumnRenamed("vec_id", "token_id"), lambda c: c)
    return out.filter("embedding is not null").select("token", F.posexplode("embedding").alias("i", "v")).withColumn("v", cents("v"))
