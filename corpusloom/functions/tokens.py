"""Token arithmetic on columns: tokenizers, truncation, labels, padding, masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import IGNORE

Tokenizer = Callable[[Column], Column]
_TOKENIZERS: dict[str, Tokenizer] = {}


def register_tokenizer(name: str, f: Tokenizer) -> None:
    if name in _TOKENIZERS:
        raise ValueError(f"tokenizer {name} exists")
    _TOKENIZERS[name] = f


def tokenizer(name: str) -> Tokenizer:
    """A function from text column to array<int>. Those here are native expressions; one that is not has ``many`` for arrays of texts."""
    return _TOKENIZERS[name]


def of_each(tok: Tokenizer, texts: Column) -> Column:
    """The ids of each text of an array. What runs in Python cannot stand inside an expression over an array."""
    return tok.many(texts) if hasattr(tok, "many") else F.transform(texts, tok)


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_id(word: Column) -> Column:
    """A stable id of a word: the first 28 bits of its MD5."""
    return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int")


register_tokenizer("whitespace", lambda t: F.transform(whitespace_words(t), word_id))
register_tokenizer("char", lambda t: F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.ascii(c)))
register_tokenizer("byte", lambda t: F.transform(F.filter(F.split(F.hex(F.encode(t, "utf-8")), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("int")))
register_tokenizer("svg-token", lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"\[<\|[^|]*\|>\]|-?\d*\.?\d+|[^\s\[\]]+"), F.lit(0)), word_id))


def infer_seqlen(source: Column, target: Column, cutoff: Column | int) -> tuple[Column, Column]:
    """How much of source and target fit into ``cutoff`` tokens together."""
    cutoff = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    share = (cutoff * (target / (source + target))).cast("int")
    most = F.when(target * 2 < cutoff, cutoff).when(source * 2 < cutoff, cutoff - source).otherwise(share)
    new_target = F.least(most, target)
    return F.least(F.greatest(cutoff - new_target, F.lit(0)), source), new_target


def head(ids: Column, n: Column) -> Column:
    return F.slice(ids, F.lit(1), F.greatest(n, F.lit(0)))


def ignored(n: Column) -> Column:
    return F.array_repeat(F.lit(IGNORE), n.cast("int"))


def source_labels(ids: Column, train_on_prompt: bool, efficient_eos: bool, eos_id: int) -> Column:
    """Labels of a prompt: its ids, all ignored, or the previous turn's end and the rest ignored."""
    if train_on_prompt:
        return ids
    if efficient_eos:
        return F.when(F.size(ids) > 0, F.concat(F.array(F.lit(eos_id)), ignored(F.size(ids) - 1))).otherwise(F.array().cast("array<int>"))
    return ignored(F.size(ids))


def padded(df: DataFrame, column: str, pad: int, batch: str, multiple: int = 8, out: str | None = None) -> DataFrame:
    """``column`` padded on the right to the longest of its batch, rounded up to a multiple."""
    width = F.max(F.size(column)).over(Window.partitionBy(batch))
    width = (F.ceil(width / multiple) * multiple).cast("int")
    return df.withColumn(out or column, F.concat(F.col(column), F.array_repeat(F.lit(pad), width - F.size(column))))


def rotated(ids: Column, pad: int) -> Column:
    """Leading pads moved to the end; the list is gone through once."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("lead"))
    step = lambda a, x: F.struct((a["n"] + (a["lead"] & (x == pad)).cast("int")).alias("n"), (a["lead"] & (x == pad)).alias("lead"))
    lead = F.aggregate(ids, start, step, lambda a: a["n"])
    return F.concat(F.slice(ids, lead + 1, F.size(ids)), F.array_repeat(F.lit(pad), lead))


def block_causal_mask(mask: Column) -> Column:
    """For packed rows: may position i see j? 1 if both belong to one item and j <= i."""
    at = F.sequence(F.lit(1), F.size(mask))
    see = lambda i, j: ((F.element_at(mask, i) == F.element_at(mask, j)) & (F.element_at(mask, i) != 0) & (j <= i)).cast("int")
    return F.transform(at, lambda i: F.transform(at, lambda j: see(i, j)))


def sequence_lengths(mask: Column) -> Column:
    """Lengths of the packed items 1, 2, ... of a row; missing numbers are left out. The sorted numbers are gone through once."""
    items = F.array_sort(F.filter(mask, lambda x: x > 0))
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("out"))
    step = lambda a, x: F.when(x == a["last"], F.struct(a["last"].alias("last"), (a["n"] + 1).alias("n"), a["out"].alias("out"))).otherwise(F.struct(x.alias("last"), F.lit(1).alias("n"), F.when(a["n"] > 0, F.concat(a["out"], F.array(a["n"]))).otherwise(a["out"]).alias("out")))
    return F.aggregate(items, start, step, lambda a: F.when(a["n"] > 0, F.concat(a["out"], F.array(a["n"]))).otherwise(a["out"]))


def cumulative(lengths: Column) -> Column:
    """Prefix sums with a leading 0."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def valid_labels(labels: Column) -> Column:
    return F.filter(labels, lambda x: x != IGNORE)


def without(ids: Column, others: Column) -> Column:
    """The list's distinct ids that the other list does not hold, in order."""
    return F.array_except(ids, others)


def within(ids: Column, others: Column) -> Column:
    """Whether every id of the list is in the other one."""
    return F.size(F.array_except(ids, others)) == 0


def joined(ids: Column, others: Column) -> Column:
    """The distinct ids of both lists: those of the first, then the new ones of the second."""
    return F.array_union(ids, others)


def token_types(ids: Column, image_id: int) -> Column:
    """1 where a token stands for a piece of an image."""
    return F.transform(ids, lambda x: (x == image_id).cast("int"))


def prefix_token_types(images: Column, image_tokens: int, length: Column) -> Column:
    """0 for the images' tokens in front, 1 for the rest."""
    front = images * image_tokens
    return F.concat(F.array_repeat(F.lit(0), front), F.array_repeat(F.lit(1), F.greatest(length - front, F.lit(0))))


def masked_prompt_labels(ids: Column, prompt_tokens: Column) -> Column:
    """The first tokens, as many as the prompt has, ignored."""
    n = F.least(prompt_tokens, F.size(ids))
    return F.concat(ignored(n), F.slice(ids, n + 1, F.size(ids)))


def number(text: Column) -> Column:
    """A number text for tokens: whole if integral, else 2 decimals; null if it is no number. Native; ties of binary fractions round half up."""
    value = text.try_cast("double")
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.round(value, 2).cast("string"))


NUMBER, COLOUR = r"-?\d*\.?\d+", r"#(?:[0-9a-fA-F]{3}){1,2}"


def with_placeholders(text: Column, colours: bool = False) -> tuple[Column, Column, Column]:
    """(text with [<|COORD|>] and [<|COLOR|>], its numbers, its colours); digits inside colours are safe only with ``colours``."""
    spaced = F.trim(F.regexp_replace(F.replace(F.replace(text, F.lit("]"), F.lit("] ")), F.lit("["), F.lit(" [")), r"(?U)\s+", " "))
    found = F.regexp_extract_all(spaced, F.lit(COLOUR), F.lit(0)) if colours else F.array().cast("array<string>")
    plain = F.regexp_replace(spaced, COLOUR, " [<|COLOR|>] ") if colours else spaced
    numbers = F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(0))
    marked = F.trim(F.regexp_replace(F.regexp_replace(plain, NUMBER, " [<|COORD|>] "), r"(?U)\s+", " "))
    return marked, numbers, found


def refilled(text: Column, numbers: Column) -> Column:
    """Placeholders replaced by numbers with two decimals, in order; ``<missing_num>`` when they run out."""
    parts = F.split(text, r"\[<\|COORD\|>\]", -1)
    fill = lambda i: F.coalesce(F.concat(F.lit(" "), F.format_string("%.2f", F.get(numbers, i - 1)), F.lit(" ")), F.lit(" <missing_num> "))
    return F.trim(F.regexp_replace(F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(fill(i), p))), ""), r"(?U)\s+", " "))
