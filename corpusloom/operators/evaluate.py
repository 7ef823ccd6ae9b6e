"""Evaluation: accuracies, preference metrics, perplexity, overlap scores, benchmark prompts."""

from __future__ import annotations

from collections import Counter
from math import exp, log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import IGNORE
from corpusloom.operators.mix import random_key


def token_accuracy(pred: Column, labels: Column) -> Column:
    """Share of right predictions where labels count, each prediction against the next label; NaN if none counts."""
    pairs = F.zip_with(F.slice(pred, F.lit(1), F.greatest(F.size(pred) - 1, F.lit(0))), F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda p, t: F.struct(p.alias("p"), t.alias("t")))
    counted = F.filter(pairs, lambda x: x["t"] != IGNORE)
    right = F.size(F.filter(counted, lambda x: x["p"] == x["t"]))
    return F.when(F.size(counted) > 0, right / F.size(counted)).otherwise(F.lit(float("nan")))


def choice(scores: Column) -> Column:
    """The letter of the highest score; the first of equals."""
    return F.chr(F.ascii(F.lit("A")) + F.array_position(scores, F.array_max(scores)) - 1)


def category_accuracy(df: DataFrame, category: str, correct: str) -> DataFrame:
    """Accuracy in per cent per category and overall (``Average``)."""
    out = df.groupingSets([[F.col(category)], []], F.col(category)).agg(F.grouping(category).alias("__all"), F.count("*").alias("n"), (F.avg(F.col(correct).cast("double")) * 100).alias("accuracy"))
    return out.select(F.when(F.col("__all") == 1, F.lit("Average")).otherwise(F.col(category)).alias("category"), "n", "accuracy")


def categorised(df: DataFrame, subjects: DataFrame, subject: str = "subject", category: str = "category") -> DataFrame:
    """Rows with the category of their subject, by a look-up table (subject, category); a subject that it lacks, or names twice, is an error."""
    twice = F.raise_error(F.concat(F.lit("named twice: "), F.col(subject).cast("string"))).cast("string")
    once = subjects.groupBy(subject).agg(F.count("*").alias("__n"), F.first(category).alias("__c")).withColumn("__c", F.when(F.col("__n") > 1, twice).otherwise(F.col("__c").cast("string"))).drop("__n")
    missing = F.raise_error(F.concat(F.lit("no category: "), F.coalesce(F.col(subject).cast("string"), F.lit("null")))).cast("string")
    return df.join(once, subject, "left").withColumn(category, F.coalesce("__c", missing)).drop("__c")


def perplexity(df: DataFrame, key: str, nll: str, mask: str) -> DataFrame:
    """Per key exp of the mean masked loss; a corpus takes the mean of these."""
    return df.groupBy(key).agg(F.exp(F.sum(F.col(nll) * F.col(mask)) / F.sum(mask)).alias("perplexity"))


def reward_accuracy(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    return df.agg(F.avg((F.col(chosen) > F.col(rejected)).cast("double")).alias("accuracy"))


def preference_metrics(df: DataFrame, chosen: str, rejected: str, measures: tuple[str, ...] = (), own_loss: str | None = None, loss: str | None = None, beta: float = 0.1) -> DataFrame:
    """Mean rewards of both sides, accuracy and margin.

    ``measures`` (such as logps and logits) are means of columns ``chosen_<name>`` and ``rejected_<name>``. With the loss on the
    chosen answer and the whole loss of each row, their mean and that of the odds-ratio part.
    """
    c, r = F.col(chosen), F.col(rejected)
    out = {"rewards_chosen": F.avg(c), "rewards_rejected": F.avg(r), "rewards_accuracies": F.avg((c > r).cast("double")), "rewards_margins": F.avg(c - r)}
    out |= {f"{m}_{side}": F.avg(f"{side}_{m}") for m in measures for side in ("chosen", "rejected")}
    if own_loss and loss:
        out |= {"sft_loss": F.avg(own_loss), "odds_ratio_loss": F.avg((F.col(loss) - F.col(own_loss)) / beta)}
    return df.agg(*(a.alias(n) for n, a in out.items()))


def class_means(df: DataFrame, reward: str, tag: str) -> DataFrame:
    """Sums, counts and means of rewards of preferred and other rows, and the margin; NaN and null rewards are left out."""
    value = F.when(~F.isnan(reward), F.col(reward))
    aggs = {}
    for name, test in (("chosen", F.col(tag)), ("rejected", ~F.col(tag))):
        aggs |= {f"{name}_sum": F.sum(F.when(test, value)), f"{name}_count": F.count(F.when(test, value))}
    out = df.agg(*(a.alias(n) for n, a in aggs.items()))
    mean = lambda n: F.when(F.col(f"{n}_count") > 0, F.col(f"{n}_sum") / F.col(f"{n}_count"))
    return out.withColumns({"chosen_mean": mean("chosen"), "rejected_mean": mean("rejected")}).withColumn("margin", F.col("chosen_mean") - F.col("rejected_mean"))


def feedback_metrics(df: DataFrame, tag: str, measures: tuple[str, ...] = ("rewards", "logps", "logits"), kl: str | None = None) -> DataFrame:
    """Per class (by the tag) the sum of each measure over its rows, by the number of all its rows; the margin of rewards; the mean kl.

    A NaN adds nothing to a sum, and its row is counted, as in the published trainer. A class without rows is null.
    """
    out = {}
    for name, test in (("chosen", F.col(tag)), ("rejected", ~F.col(tag))):
        for m in measures:
            total = F.sum(F.when(test, F.when(F.isnan(m), F.lit(0.0)).otherwise(F.coalesce(F.col(m), F.lit(0.0)))))
            out[f"{m}_{name}"] = total / F.nullif(F.count_if(test), F.lit(0))
    if kl:
        out["kl"] = F.avg(kl)
    means = df.agg(*(a.alias(n) for n, a in out.items()))
    return means.withColumn("rewards_margins", F.col("rewards_chosen") - F.col("rewards_rejected")) if "rewards" in measures else means


def zipped(order: str = "row_idx", **tables: DataFrame) -> DataFrame:
    """Rows of several tables side by side, by their place: order, and a column per table, named as it is told; each has one column besides.

    Tables of different lengths are an error, as rows would be paired with the wrong ones.
    """
    out = None
    for name, t in tables.items():
        (own,) = (c for c in t.columns if c != order)
        part = t.select(F.col(order), F.struct(F.col(own)).alias(name))
        out = part if out is None else out.join(part, order, "full")
    whole = {n: F.when(F.col(n).isNull(), F.raise_error(F.lit(f"{n} has too few rows")).cast(out.schema[n].dataType)).otherwise(F.col(n)) for n in tables}
    out = out.withColumns(whole)
    return out.select(order, *(F.col(n).getField(out.schema[n].dataType.fieldNames()[0]).alias(n) for n in tables))


def sequence_logps(logps: Column, labels: Column) -> tuple[Column, Column]:
    """(sum of the labels' log-probabilities that count, how many): place i of ``logps`` belongs to label i + 1."""
    pairs = F.zip_with(logps, F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda p, t: F.when(t != IGNORE, p))
    kept = F.filter(pairs, lambda x: x.isNotNull())
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept)


def odds_ratio_loss(chosen: Column, rejected: Column, beta: float) -> Column:
    """On mean log-probabilities: the answer's own loss and the log-odds against the other."""
    odds = (chosen - rejected) - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))
    return -chosen + beta * F.log1p(F.exp(-odds))


def margin_loss(chosen: Column, rejected: Column, beta: float, gamma: float) -> Column:
    """On mean log-probabilities: a target margin between the two."""
    logits = beta * (chosen - rejected - gamma / beta)
    return F.log1p(F.exp(-logits))


def reward(logp: Column, reference: Column, beta: float) -> Column:
    return beta * (logp - reference)


# --- overlap scores -----------------------------------------------------------------------------------------------


def bleu4(prediction: str, label: str) -> float:
    """Characters as tokens, 1- to 4-grams of equal weight, brevity penalty; orders without a match count 1, 1/2, 1/4 ... of a match.

    Smoothing by geometrically falling counts (Chen and Cherry, 2014, method 3). In per cent, 4 decimals.
    """
    hyp, ref = list(prediction), list(label)
    if not hyp:
        return 0.0
    total, falls = 0.0, 1
    for n in range(1, 5):
        have = Counter(tuple(hyp[i : i + n]) for i in range(len(hyp) - n + 1))
        want = Counter(tuple(ref[i : i + n]) for i in range(len(ref) - n + 1))
        hits, size = sum((have & want).values()), max(1, sum(have.values()))
        if n == 1 and not hits:
            return 0.0
        if hits:
            total += log(hits / size) / 4
        else:
            total += log(1 / (2**falls * size)) / 4
            falls += 1
    brevity = 1.0 if len(hyp) > len(ref) else exp(1 - len(ref) / len(hyp))
    return round(100 * brevity * exp(total), 4)


def longest_common(hyp: list[str], ref: list[str]) -> int:
    """Length of the longest common subsequence by bit vectors: one integer of a bit per word of the shorter list."""
    short, long = sorted((hyp, ref), key=len)
    at: dict[str, int] = {}
    for i, w in enumerate(short):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(short)) - 1
    free = full
    for w in long:
        if own := free & at.get(w, 0):
            free = ((free + own) | (free - own)) & full
    return len(short) - free.bit_count()


def rouge(prediction: str, label: str) -> tuple[float, float, float]:
    """F of ROUGE-1, -2 and -L over white-space words, in per cent, 4 decimals; 0 if either is empty."""
    hyp, ref = prediction.split(), label.split()
    if not hyp or not ref:
        return 0.0, 0.0, 0.0

    def f(hits: float, a: int, b: int) -> float:
        p, r = (hits / a if a else 0.0), (hits / b if b else 0.0)
        return round(100 * 2 * p * r / (p + r + 1e-8), 4)

    out = []
    for n in (1, 2):
        a, b = ({tuple(x[i : i + n]) for i in range(len(x) - n + 1)} for x in (hyp, ref))
        out.append(f(len(a & b), len(a), len(b)))
    return out[0], out[1], f(longest_common(hyp, ref), len(hyp), len(ref))


def overlap_scores(df: DataFrame, prediction: str = "predict", label: str = "label", segment=None) -> DataFrame:
    """bleu_4, rouge_1, rouge_2, rouge_l of every row; ``segment`` turns a text into words joined by spaces."""
    words = segment or (lambda t: t)

    @F.pandas_udf("bleu_4 double, rouge_1 double, rouge_2 double, rouge_l double")
    def score(predicted: pd.Series, labels: pd.Series) -> pd.DataFrame:
        rows = [(bleu4(a or "", b or ""), *rouge(words(a or ""), words(b or ""))) for a, b in zip(predicted, labels, strict=True)]
        return pd.DataFrame(rows, columns=["bleu_4", "rouge_1", "rouge_2", "rouge_l"])

    return df.withColumn("__s", score(prediction, label)).select(*df.columns, "__s.*")


def decoded_predictions(df: DataFrame, tok, ids: str = "predict_ids", labels: str = "label_ids", prompt: str = "prompt_ids") -> DataFrame:
    """prompt, predict and label as texts: labels without those that are ignored; ``tok`` decodes a column of ids."""
    kept = F.filter(labels, lambda x: x != IGNORE)
    out = {"prompt": tok.decode(F.col(prompt)), "predict": tok.decode(F.col(ids)), "label": tok.decode(kept)}
    return df.withColumns(out).drop(prompt, ids, labels)


def macro_mean(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*(F.avg(c).alias(c) for c in sorted(columns)))


# --- benchmark prompts --------------------------------------------------------------------------------------------

#: The words of a benchmark prompt, by language.
EVAL_TEMPLATES = {
    "en": {"system": "The following are multiple choice questions (with answers) about {subject}.\n\n", "choice": "\n{choice}. {content}", "answer": "\nAnswer:"},
    "zh": {"system": "以下是中国关于{subject}考试的单项选择题，请选出其中的正确答案。\n\n", "choice": "\n{choice}. {content}", "answer": "\n答案："},
}
CHOICES = ("A", "B", "C", "D")


def register_eval_template(name: str, system: str, choice: str, answer: str) -> None:
    """Words of a benchmark prompt for another language; {subject}, {choice} and {content} stand for what is filled in."""
    if name in EVAL_TEMPLATES:
        raise ValueError(f"evaluation template {name} exists")
    if "{subject}" not in system or "{choice}" not in choice or "{content}" not in choice:
        raise ValueError("a template needs {subject}, {choice} and {content}")
    EVAL_TEMPLATES[name] = {"system": system, "choice": choice, "answer": answer}




def question(language: str, prefix: str = "") -> Column:
    """The question with its choices, from columns question, A, B, C and D."""
    t = EVAL_TEMPLATES[language]
    at = lambda c: F.col(f"{prefix}{c}")
    shown = []
    for c in CHOICES:
        before, after = t["choice"].format(choice=c, content="\0").split("\0")
        shown += [F.lit(before), at(c)] + ([F.lit(after)] if after else [])
    return F.concat(at("question"), *shown, F.lit(t["answer"]))


def few_shot(test: DataFrame, dev: DataFrame, n_shot: int, language: str = "en", seed: int = 42, key: str = "item_id", subject: str = "subject") -> DataFrame:
    """key, messages, label: n_shot examples of the subject drawn anew (seeded) for every test row, then its question.

    The few-shot pool of a subject is a handful of rows, so the lateral draw is an equi-join on the subject.
    """
    shots = dev.select(F.col(subject), F.col(key).alias("__d"), question(language).alias("__q"), F.col("answer").alias("__a"))
    asked = test.select(key, subject, question(language).alias("__ask"), F.col("answer").alias("label"))
    drawn = asked.join(shots, subject).withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(random_key(seed, key, "__d"))))
    picked = drawn.filter(F.col("__r") <= n_shot).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__r", "__q", "__a"))).alias("__s"))
    out = asked.join(picked, key, "left")
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    told = F.coalesce(F.flatten(F.transform("__s", lambda x: F.array(turn("user", x["__q"]), turn("assistant", x["__a"])))), F.expr("cast(array() as array<struct<role:string,content:string>>)"))
    messages = F.concat(told, F.array(turn("user", F.col("__ask"))))
    before, after = EVAL_TEMPLATES[language]["system"].split("{subject}")
    head = F.concat(F.lit(before), F.col(subject), F.lit(after))
    first = F.transform(messages, lambda m, i: F.when(i == 0, turn_with(m, head)).otherwise(m))
    return out.select(key, first.alias("messages"), "label")


def turn_with(message: Column, head: Column) -> Column:
    return F.struct(message["role"].alias("role"), F.concat(head, message["content"]).alias("content"))
