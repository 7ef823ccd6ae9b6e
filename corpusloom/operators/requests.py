"""Chat requests as canonical rows, in native expressions over a parsed (variant) column.

A request is a JSON text with ``messages`` and perhaps ``tools``. A leading system message is peeled off; the rest must alternate
between what asks (user, tool) and what answers (assistant, function), and end with a question. An assistant's tool calls become a
function turn; a content of several parts becomes a text with placeholders, and its media are listed by kind, in order. What is
wrong with a request is told in ``error``, and its other columns are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.media import PLACEHOLDERS

#: What a request's roles are in canonical rows; the kinds of parts and the placeholders they leave.
ROLES = {"user": "user", "assistant": "assistant", "system": "system", "function": "function", "tool": "observation"}
PARTS = {"image_url": "image", "video_url": "video", "audio_url": "audio"}
MESSAGE = "struct<role:string,content:variant,tool_calls:variant>"


def _is_list(v: Column) -> Column:
    """Whether a variant is a list with something in it."""
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY") & (F.size(F.try_variant_get(v, "$", "array<variant>")) > 0), F.lit(False))


def _parts(content: Column) -> Column:
    return F.try_variant_get(content, "$", "array<struct<type:string,text:string,image_url:struct<url:string>,video_url:struct<url:string>,audio_url:struct<url:string>>>")


def _of_parts(content: Column) -> Column:
    """The text of a content of several parts."""
    def said(p: Column) -> Column:
        out = F.when(p["type"] == "text", F.coalesce(p["text"], F.lit("")))
        for kind, medium in PARTS.items():
            out = out.when(p["type"] == kind, F.lit(PLACEHOLDERS[medium]))
        return out.otherwise(F.lit(""))

    return F.array_join(F.transform(_parts(content), said), "")


def _strange(content: Column) -> Column:
    """The first part of a kind that is not known."""
    known = ("text", *PARTS)
    kinds = F.filter(F.transform(_parts(content), lambda p: F.coalesce(p["type"], F.lit("null"))), lambda t: ~t.isin(*known))
    return F.when(F.size(kinds) > 0, F.get(kinds, F.lit(0)))


def _media(messages: Column, kind: str) -> Column:
    """The locations of all media of a kind, in the order of their placeholders; none at all is a null."""
    per = F.transform(messages, lambda m: F.when(_plain_call(m), F.array().cast("array<string>")).when(_is_list(m["content"]), F.transform(F.filter(_parts(m["content"]), lambda p: p["type"] == kind), lambda p: p[kind]["url"])).otherwise(F.array().cast("array<string>")))
    flat = F.flatten(per)
    return F.when(F.size(flat) > 0, flat)


def _plain_call(m: Column) -> Column:
    return (m["role"] == "assistant") & _is_list(m["tool_calls"])


def _calls(m: Column) -> Column:
    """An assistant's calls as the JSON text of a function turn."""
    given = F.try_variant_get(m["tool_calls"], "$", "array<struct<function:struct<name:string,arguments:string>>>")
    quoted = lambda t: F.to_json(F.array(t))
    inner = lambda t: F.substring(quoted(t), F.lit(2), F.length(quoted(t)) - 2)
    each = F.transform(given, lambda c: F.concat(F.lit('{"name": '), inner(c["function"]["name"]), F.lit(', "arguments": '), inner(c["function"]["arguments"]), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))


def _turn(m: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    text = F.when(_is_list(m["content"]), _of_parts(m["content"])).otherwise(F.try_variant_get(m["content"], "$", "string"))
    call = _plain_call(m)
    return F.struct(F.when(call, F.lit("function")).otherwise(F.try_element_at(names, m["role"])).alias("role"), F.when(call, _calls(m)).otherwise(text).alias("content"))


def problem(messages: Column, body: Column) -> Column:
    """What is wrong with a request, the first thing first; null if nothing is."""
    strange = F.filter(F.transform(body, lambda m: F.when(~_plain_call(m) & _is_list(m["content"]), _strange(m["content"]))), lambda t: t.isNotNull())
    fits = F.forall(F.transform(body, lambda m, i: F.coalesce(F.when(i % 2 == 0, m["role"].isin("user", "tool")).otherwise(m["role"].isin("assistant", "function")), F.lit(False))), lambda ok: ok)
    return (
        F.when(messages.isNull(), "the request cannot be read")
        .when(F.size(messages) == 0, "no messages")
        .when(F.size(body) % 2 == 0, "questions and answers have to alternate and end with a question")
        .when(~fits, "a role stands where it cannot")
        .when(F.size(strange) > 0, F.concat(F.lit("unknown kind of part: "), F.get(strange, F.lit(0))))
    )


def converted(df: DataFrame, column: str = "request") -> DataFrame:
    """The rows with _prompt, _system, _tools, _images, _videos, _audios and error, in place of ``column``.

    ``_system``, ``_tools`` and the media are null where the request has none; tools are the JSON text of their functions.
    """
    parsed = F.try_parse_json(column)
    messages = F.try_variant_get(parsed, "$.messages", f"array<{MESSAGE}>")
    rows = df.withColumns({"__v": parsed}).withColumn("__m", messages)
    led = F.get("__m", F.lit(0))["role"] == "system"
    rows = rows.withColumn("__led", F.coalesce(led, F.lit(False)))
    rows = rows.withColumn("__body", F.when(F.col("__led"), F.slice("__m", F.lit(2), F.greatest(F.size("__m") - 1, F.lit(0)))).otherwise(F.col("__m")))
    rows = rows.withColumn("error", problem(F.col("__m"), F.col("__body")))
    sound = F.col("error").isNull()
    system = F.when(F.col("__led"), F.try_variant_get(F.get("__m", F.lit(0))["content"], "$", "string"))
    tools = F.try_variant_get("__v", "$.tools", "array<struct<function:variant>>")
    functions = F.concat(F.lit("["), F.array_join(F.transform(tools, lambda t: F.to_json(t["function"])), ", "), F.lit("]"))
    out = {
        "_prompt": F.when(sound, F.transform("__body", _turn)), "_system": F.when(sound, system), "_tools": F.when(sound & (F.size(tools) > 0), functions),
        **{f"_{medium}s": F.when(sound, _media(F.col("__body"), kind)) for kind, medium in PARTS.items()},
    }
    return rows.withColumns(out).drop("__v", "__m", "__led", "__body", column)
