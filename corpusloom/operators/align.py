"""Alignment of source rows to one canonical message schema.

Canonical columns: _prompt and _response (arrays of role and content), _system, _tools, _images, _videos, _audios.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.config import DatasetSpec
from corpusloom.sources.media_files import resolved

MESSAGES = "array<struct<role:string,content:string>>"
#: Kinds of media in aligned rows.
aligned_media = ("images", "videos", "audios")
Converter = Callable[[DataFrame, DatasetSpec], DataFrame]
_CONVERTERS: dict[str, Converter] = {}


def register_converter(name: str, f: Converter) -> None:
    if name in _CONVERTERS:
        raise ValueError(f"converter {name} exists")
    _CONVERTERS[name] = f


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def none() -> Column:
    return F.expr(f"cast(array() as {MESSAGES})")


def _kind(df: DataFrame, name: str | None) -> T.DataType | None:
    return df.schema[name].dataType if name else None


def _media(df: DataFrame, spec: DatasetSpec, part: str) -> Column:
    """A path or list of paths as a list; empty lists become null."""
    name = spec.column(part)
    if not name:
        return F.lit(None).cast("array<string>")
    listed = F.col(name) if isinstance(_kind(df, name), T.ArrayType) else F.when(F.col(name).isNotNull(), F.array(name))
    return F.when(F.size(listed) > 0, listed)


def _ends(df: DataFrame, spec: DatasetSpec, system: Column) -> list[Column]:
    text = lambda part: F.col(spec.column(part)) if spec.column(part) else F.lit("")
    return [system.alias("_system"), text("tools").alias("_tools")] + [_media(df, spec, m).alias(f"_{m}") for m in aligned_media]


def _preferred(tag: Column, response: Column) -> Column:
    """The response before or after an empty one, by a preference tag."""
    empty = F.array(message("assistant", F.lit("")))
    return F.when(tag, F.concat(response, empty)).otherwise(F.concat(empty, response))


def alpaca(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Instruction rows. Which response is taken: preference tag, then ranked pair, then plain response, then none."""
    ask = [F.when(F.col(spec.column(p)) != "", F.col(spec.column(p))) for p in ("prompt", "query") if spec.column(p)]
    prompt = F.array(message("user", F.concat_ws("\n", *ask)))
    if spec.column("history"):
        told = F.flatten(F.transform(spec.column("history"), lambda h: F.array(message("user", h[0]), message("assistant", h[1]))))
        prompt = F.concat(F.coalesce(told, none()), prompt)
    response = none()
    if spec.column("response") and isinstance(_kind(df, spec.column("response")), T.StringType):
        own = F.array(message("assistant", F.col(spec.column("response"))))
        response = F.when(F.col(spec.column("response")).isNotNull(), own).otherwise(none())
    if spec.ranking and all(isinstance(_kind(df, spec.column(p)), T.StringType) for p in ("chosen", "rejected")):
        chosen, rejected = F.col(spec.column("chosen")), F.col(spec.column("rejected"))
        response = F.when(chosen.isNotNull() & rejected.isNotNull(), F.array(message("assistant", chosen), message("assistant", rejected))).otherwise(response)
    if isinstance(_kind(df, spec.column("kto_tag")), T.BooleanType):
        tag = F.col(spec.column("kto_tag"))
        answer = F.col(spec.column("response")) if spec.column("response") else F.lit(None).cast("string")
        response = F.when(tag.isNotNull(), _preferred(tag, F.array(message("assistant", answer)))).otherwise(response)
    system = F.col(spec.column("system")) if spec.column("system") else F.lit("")
    return df.select(*_kept(df), prompt.alias("_prompt"), response.alias("_response"), *_ends(df, spec, system))


def sharegpt(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Message rows: a leading system turn is peeled off; a wrong role or count empties prompt and response (the row stays)."""
    role, content = spec.tag("role_tag"), spec.tag("content_tag")
    raw = F.col(spec.column("messages") or "conversations")
    led = (F.size(raw) > 0) & (F.get(raw, F.lit(0))[role] == spec.tag("system_tag")) if spec.tag("system_tag") else F.lit(False)
    given = F.col(spec.column("system")) if spec.column("system") else F.lit("")
    system = F.when(led, F.get(raw, F.lit(0))[content]).otherwise(given)
    rest = F.when(led, F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 1, F.lit(0)))).otherwise(raw)
    names = {spec.tag(f"{r}_tag"): r for r in ("user", "assistant", "observation", "function", "system")}
    named = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    turns = F.transform(rest, lambda m: message(F.try_element_at(named, m[role]), m[content]))
    odd, even = (spec.tag("user_tag"), spec.tag("observation_tag")), (spec.tag("assistant_tag"), spec.tag("function_tag"))
    fits = F.forall(F.transform(rest, lambda m, i: F.coalesce(F.when(i % 2 == 0, m[role].isin(*odd)).otherwise(m[role].isin(*even)), F.lit(False))), lambda ok: ok)
    n = F.size(turns)
    sound = fits & (n % 2 == (1 if spec.ranking else 0))
    front, last = F.slice(turns, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(turns, F.greatest(n, F.lit(1)), F.lit(1))
    prompt, response = front, last
    if spec.ranking and all(isinstance(_kind(df, spec.column(p)), T.StructType) for p in ("chosen", "rejected")):
        chosen, rejected = F.col(spec.column("chosen")), F.col(spec.column("rejected"))
        both = chosen.isNotNull() & rejected.isNotNull()
        ranked = F.array(*(message(F.try_element_at(named, c[role]), c[content]) for c in (chosen, rejected)))
        prompt, response = F.when(both, turns).otherwise(front), F.when(both, ranked).otherwise(last)
    if isinstance(_kind(df, spec.column("kto_tag")), T.BooleanType):
        tag = F.col(spec.column("kto_tag"))
        prompt, response = F.when(tag.isNotNull(), front).otherwise(prompt), F.when(tag.isNotNull(), _preferred(tag, last)).otherwise(response)
    return df.select(
        *_kept(df), F.when(sound, prompt).otherwise(none()).alias("_prompt"), F.when(sound, response).otherwise(none()).alias("_response"), *_ends(df, spec, system)
    )


def _kept(df: DataFrame) -> list[str]:
    return [c for c in ("row_idx", "src_idx") if c in df.columns]


register_converter("alpaca", alpaca)
register_converter("sharegpt", sharegpt)


def align(df: DataFrame, spec: DatasetSpec, folder: str | None = None) -> DataFrame:
    """Rows in the canonical schema; of local sources, media that lie under ``folder`` are named by their place there."""
    if spec.formatting not in _CONVERTERS:
        raise ValueError(f"converter {spec.formatting} does not exist")
    rows = _CONVERTERS[spec.formatting](df, spec)
    kinds = [f"_{m}" for m in aligned_media if spec.column(m)]
    return resolved(rows, kinds, folder) if folder and kinds and spec.source in ("file", "script") else rows


def gathered(turns: DataFrame, key: str, order: str, role: str = "role", content: str = "text") -> DataFrame:
    """A table of turns as one row of ordered messages per key; one shuffle."""
    ordered = F.array_sort(F.collect_list(F.struct(order, role, content)))
    return turns.groupBy(key).agg(F.transform(ordered, lambda t: F.struct(t[role].alias("role"), t[content].alias("content"))).alias("messages"))


def request_problem(messages: Column) -> Column:
    """What is wrong with a chat request (roles must alternate, ending with the user), or null."""
    body = F.when(F.get(messages, F.lit(0))["role"] == "system", F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    fits = F.forall(
        F.transform(body, lambda m, i: F.when(i % 2 == 0, m["role"].isin("user", "observation", "tool")).otherwise(m["role"].isin("assistant", "function"))), lambda ok: F.coalesce(ok, F.lit(False))
    )
    return F.when(F.size(messages) == 0, "no messages").when(F.size(body) % 2 == 0, "an odd number of turns is needed").when(~fits, "roles do not alternate")


# --- validity -----------------------------------------------------------------------------------------------------


def valid(stage: str) -> Column:
    """Whether an aligned row can be encoded for a stage."""
    odd = F.size("_prompt") % 2 == 1
    if stage == "sft":
        return odd & (F.size("_response") == 1)
    if stage in ("rm", "kto"):
        return odd & (F.size("_response") >= 2)
    return odd


def media_mismatch(text: Column, placeholder: str, media: Column) -> Column:
    """Placeholders in the text less media in the list; 0 if they agree."""
    found = (F.length(text) - F.length(F.replace(text, F.lit(placeholder), F.lit("")))) / len(placeholder)
    return found.cast("int") - F.coalesce(F.size(media), F.lit(0))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns; those that are not used go before anything is read of them. A missing one is an error."""
    return require(df, *columns).select(*columns)


def not_longer(df: DataFrame, most: int, ids: str = "input_ids") -> DataFrame:
    """Rows of at most so many tokens; if none is left, an error."""
    out = df.filter(F.size(ids) <= most)
    if out.isEmpty():
        raise ValueError(f"no row of at most {most} tokens")
    return out


def require(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def joined_prompt(df: DataFrame, columns: list[str], out: str = "text_prompt") -> DataFrame:
    """Columns joined by a full stop and a space; a null one is an error, as nothing may be left out silently."""
    parts = [F.coalesce(F.col(c).cast("string"), F.raise_error(F.lit(f"{c} is null"))) for c in columns]
    return require(df, *columns).withColumn(out, F.concat_ws(". ", *parts))
