"""Encoding of aligned rows for each training stage: truncation, labels, pairs, shifts, chunks; all native expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DataArgs
from corpusloom.functions import media, templates, tools
from corpusloom.functions.tokens import head, ignored, infer_seqlen, of_each, source_labels, tokenizer
from corpusloom.operators.align import message, none, valid

EOS_ID, BOS_ID, PAD_ID = 2, 1, 0
_INTS = "cast(array() as array<int>)"


@dataclass(frozen=True)
class Extras:
    """What a row has besides text. Counts are columns by kind of medium, one entry per medium of the row."""

    media: dict[str, Column] = field(default_factory=dict)
    #: Rows may have tools or function turns. Without them encoding stays free of Python.
    tools: bool = True
    #: Ids in front of the sequence, for models that put the images there.
    front: Column | None = None


def rendered(df: DataFrame, template: templates.Template, messages: Column, eos: str, extras: Extras = Extras(), out: str = "__text") -> DataFrame:
    """``out``: the text of each message, with media expanded, function turns and the tool prompt in the template's tool format.

    The Python passes are columns of their own, as no expression over an array may hold one.
    """
    if extras.media:
        messages = media.process(messages, template.media, **extras.media)
    if not extras.tools:
        return df.withColumn(out, templates.turns(template, messages, F.col("_system"), F.lit(""), eos=eos))
    given = F.coalesce(F.col("_tools"), F.lit(""))
    # a constant empty _tools folds away, and its Python pass with it
    told = F.when(given == "", F.lit("")).otherwise(tools.tool_prompt_column(given, template.tools))
    ready = df.withColumns({"__told": told, "__said": messages})
    ready = ready.withColumn("__spoken", tools.spoken(F.col("__said"), template.tools))
    said = F.when(F.exists("__said", lambda m: m["role"] == "function"), tools.with_contents(F.col("__said"), F.col("__spoken"))).otherwise(F.col("__said"))
    return ready.withColumn(out, templates.turns(template, said, F.col("_system"), F.col("__told"), eos=eos)).drop("__told", "__said", "__spoken")




def fold_turns(rounds: Column, args: DataArgs, efficient_eos: bool = False, eos_id: int = EOS_ID, cutoff: int | None = None) -> Column:
    """struct<ids, labels>: rounds share the budget in order (last first where history is masked); each keeps its heads."""
    cutoff = args.cutoff_len if cutoff is None else cutoff
    start = F.struct(F.lit(1 if efficient_eos else 0).alias("used"), F.expr(_INTS).alias("ids"), F.expr(_INTS).alias("labels"), F.lit(0).alias("n"))

    def step(state: Column, r: Column) -> Column:
        left = F.lit(cutoff) - state["used"]
        s, t = infer_seqlen(F.size(r["source"]), F.size(r["target"]), left)
        source, target = head(r["source"], s), head(r["target"], t)
        prompt = source_labels(source, args.train_on_prompt, efficient_eos, eos_id)
        answer = F.when(state["n"] > 0, ignored(F.size(target))).otherwise(target) if args.mask_history else target
        ids, labels = F.concat(source, target), F.concat(prompt, answer)
        if args.mask_history:
            ids, labels = F.concat(ids, state["ids"]), F.concat(labels, state["labels"])
        else:
            ids, labels = F.concat(state["ids"], ids), F.concat(state["labels"], labels)
        return F.when(state["used"] >= cutoff, state).otherwise(F.struct((state["used"] + s + t).alias("used"), ids.alias("ids"), labels.alias("labels"), (state["n"] + 1).alias("n")))

    done = F.aggregate(F.reverse(rounds) if args.mask_history else rounds, start, step)
    end = F.array(F.lit(eos_id)) if efficient_eos else F.expr(_INTS)
    return F.transform(F.array(done), lambda d: F.struct(F.concat(d["ids"], end).alias("ids"), F.concat(d["labels"], end).alias("labels")))[0]


def supervised(df: DataFrame, template: str, args: DataArgs, tok: str = "whitespace", eos: str = "</s>", extras: Extras = Extras()) -> DataFrame:
    """input_ids, attention_mask, labels of the valid rows."""
    t = templates.get(template)
    rows = rendered(df.filter(valid("sft")), t, F.concat("_prompt", "_response"), eos, extras)
    rows = rows.withColumn("__ids", of_each(tokenizer(tok), F.col("__text")))
    folded = fold_turns(templates.pairs(F.col("__ids")), args, t.efficient_eos, cutoff=args.capacity)
    return _sequence(rows.withColumn("__e", folded).drop("__text", "__ids"), front=extras.front)


def _sequence(df: DataFrame, prefix: str = "", front: Column | None = None) -> DataFrame:
    ids, labels = F.col("__e.ids"), F.col("__e.labels")
    if front is not None:
        ids, labels = F.concat(front, ids), F.concat(ignored(F.size(front)), labels)
    out = df.withColumns({f"{prefix}input_ids": ids, f"{prefix}labels": labels}).drop("__e")
    return out.withColumn(f"{prefix}attention_mask", F.array_repeat(F.lit(1), F.size(f"{prefix}input_ids")))


def pairwise(df: DataFrame, template: str, args: DataArgs, tok: str = "whitespace", eos: str = "</s>", extras: Extras = Extras()) -> DataFrame:
    """chosen_ and rejected_ input_ids, labels, attention_mask: one prompt, cut for the longer of the two answers."""
    t, f = templates.get(template), tokenizer(tok)
    rows = df.filter(valid("rm"))
    sides = {}
    for i, name in enumerate(("chosen", "rejected")):
        whole = F.concat("_prompt", F.slice("_response", i + 1, 1))
        rows = rendered(rows, t, whole, eos, extras, f"__{name}_text")
        prompt, answer = templates.one_turn(F.col(f"__{name}_text"))
        end = F.array(F.lit(EOS_ID)) if t.efficient_eos else F.expr(_INTS)
        sides |= {"__prompt": f(prompt), f"__{name}": F.concat(f(answer), end)}
    rows = rows.withColumns(sides)
    s, n = infer_seqlen(F.size("__prompt"), F.greatest(F.size("__chosen"), F.size("__rejected")), args.cutoff_len)
    rows = rows.withColumns({"__s": s, "__n": n})
    for name in ("chosen", "rejected"):
        source, target = head(F.col("__prompt"), F.col("__s")), head(F.col(f"__{name}"), F.col("__n"))
        rows = rows.withColumns({f"{name}_input_ids": F.concat(source, target), f"{name}_labels": F.concat(ignored(F.size(source)), target)})
        rows = rows.withColumn(f"{name}_attention_mask", F.array_repeat(F.lit(1), F.size(f"{name}_input_ids")))
    return rows.drop("__prompt", "__chosen", "__rejected", "__chosen_text", "__rejected_text", "__s", "__n")


def shifted(df: DataFrame, column: str, batch: str = "batch_id", order: str = "row_idx", out: str = "_kl_response") -> DataFrame:
    """The previous row's value inside a batch; the first row gets the last one's."""
    w = Window.partitionBy(batch).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.lag(column).over(w), F.last(column).over(whole)))


def batched(df: DataFrame, size: int = 1000) -> DataFrame:
    """batch_id: consecutive rows, ``size`` at a time."""
    return df.withColumn("batch_id", F.floor(F.col("row_idx") / size).cast("long"))


def feedback(df: DataFrame, template: str, args: DataArgs, tok: str = "whitespace", eos: str = "</s>", extras: Extras = Extras()) -> DataFrame:
    """Preference rows: own sequence, that with the previous row's answer (kl_), and kto_tags (does the first answer have text?)."""
    t, f = templates.get(template), tokenizer(tok)
    rows = shifted(batched(df, args.batch_size), "_response").filter(valid("kto"))
    answer = lambda c: F.when(F.get(c, F.lit(0))["content"] != "", F.get(c, F.lit(0))).otherwise(F.get(c, F.lit(1)))
    tag = F.get("_response", F.lit(0))["content"] != ""
    own = F.struct(F.coalesce(answer(F.col("_response"))["role"], F.lit("assistant")).alias("role"), answer(F.col("_response"))["content"].alias("content"))
    kl = message("assistant", F.coalesce(answer(F.col("_kl_response"))["content"], F.lit("")))
    rows = rows.withColumn("kto_tags", tag)
    end = F.array(F.lit(EOS_ID)) if t.efficient_eos else F.expr(_INTS)
    for prefix, last in (("", own), ("kl_", kl)):
        rows = rendered(rows, t, F.concat("_prompt", F.array(last)), eos, extras)
        prompt, response = templates.one_turn(F.col("__text"))
        rows = rows.withColumns({"__p": f(prompt), "__r": F.concat(f(response), end)})
        s, n = infer_seqlen(F.size("__p"), F.size("__r"), args.cutoff_len)
        source, target = head(F.col("__p"), s), head(F.col("__r"), n)
        rows = _sequence(rows.withColumn("__e", F.struct(F.concat(source, target).alias("ids"), F.concat(ignored(F.size(source)), target).alias("labels"))), prefix)
    return rows.drop("__p", "__r", "__text")


def balance(df: DataFrame) -> DataFrame:
    """How many preferred and not preferred rows; one kind alone is worth a warning."""
    return df.agg(F.count_if("kto_tags").alias("desirable"), F.count_if(~F.col("kto_tags")).alias("undesirable")).withColumn("unbalanced", (F.col("desirable") == 0) | (F.col("undesirable") == 0))


def unsupervised(df: DataFrame, template: str, args: DataArgs, tok: str = "whitespace", eos: str = "</s>", extras: Extras = Extras()) -> DataFrame:
    """input_ids of the prompt, labels of the response (an empty answer where there is none)."""
    t, f = templates.get(template), tokenizer(tok)
    rows = df.filter(valid("unsupervised"))
    answer = F.when(F.size("_response") == 1, F.col("_response")).otherwise(F.array(message("assistant", F.lit(""))))
    rows = rendered(rows, t, F.concat("_prompt", answer), eos, extras)
    prompt, response = templates.one_turn(F.col("__text"))
    end = F.array(F.lit(EOS_ID)) if t.efficient_eos else F.expr(_INTS)
    rows = rows.withColumns({"__p": f(prompt), "__r": F.concat(f(response), end)})
    s, n = infer_seqlen(F.size("__p"), F.size("__r"), args.cutoff_len)
    return _sequence(rows.withColumn("__e", F.struct(head(F.col("__p"), s).alias("ids"), head(F.col("__r"), n).alias("labels")))).drop("__p", "__r", "__text")


def pretrain_ids(df: DataFrame, text: Column, tok: str = "whitespace", eos_id: int = EOS_ID, add_bos: bool = False, cutoff: int | None = None) -> DataFrame:
    """input_ids of a text and the end token, with the begin token on demand, cut to ``cutoff`` unless it is to be chunked."""
    ids = F.concat(tokenizer(tok)(text), F.array(F.lit(eos_id)))
    if add_bos and cutoff is not None:
        ids = F.concat(F.array(F.lit(BOS_ID)), ids)
    return df.withColumn("input_ids", ids if cutoff is None else F.slice(ids, 1, cutoff))


def chunks(df: DataFrame, block: int, batch: str = "batch_id", order: str = "row_idx", ids: str = "input_ids", bos_id: int | None = None) -> DataFrame:
    """A batch's tokens end to end, in full blocks only: batch, block, input_ids. Batches are of fixed size, so tasks stay small.

    Each row is cut where blocks end, and the pieces are shuffled whole.
    """
    w = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.select(batch, order, ids, F.coalesce(F.sum(F.size(ids)).over(w), F.lit(0)).alias("__ahead")).filter(F.size(ids) > 0)
    first, last = F.floor(F.col("__ahead") / block), F.floor((F.col("__ahead") + F.size(ids) - 1) / block)

    def piece(b: Column) -> Column:
        start = F.greatest(b * block, F.col("__ahead"))
        end = F.least((b + 1) * block, F.col("__ahead") + F.size(ids))
        return F.struct(b.cast("long").alias("block"), start.alias("start"), F.slice(F.col(ids), (start - F.col("__ahead") + 1).cast("int"), (end - start).cast("int")).alias("piece"))

    pieces = placed.select(batch, F.inline(F.transform(F.sequence(first, last), piece)))
    out = pieces.groupBy(batch, "block").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("__s"))
    made = F.flatten(F.col("__s.piece"))
    full = out.select(batch, "block", made.alias("input_ids")).filter(F.size("input_ids") == block)
    if bos_id is None:
        return full
    return full.withColumn("input_ids", F.concat(F.array(F.lit(bos_id)), F.slice("input_ids", 2, block)))


def aligned_text(df: DataFrame) -> Column:
    return F.get("_prompt", F.lit(0))["content"]


__all__ = ["balance", "batched", "chunks", "feedback", "fold_turns", "none", "pairwise", "pretrain_ids", "shifted", "supervised", "unsupervised"]
