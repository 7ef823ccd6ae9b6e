"""Tools, function turns and media inside encoded rows."""

import json

import pytest
from corpusloom.config import DataArgs
from corpusloom.functions import media, templates, tools
from corpusloom.functions.tokens import tokenizer
from corpusloom.operators import encode
from pyspark.sql import functions as F

TOOL = {"name": "f", "description": "Adds", "parameters": {"type": "object", "properties": {"a": {"type": "integer", "description": "one"}}, "required": ["a"]}}
CALL = '[{"name": "f", "arguments": {"a": 1}}]'


def whole_talk():
    return F.concat("_prompt", "_response")


def rows(spark, extra=""):
    talk = [("user", "sum " + extra), ("function", CALL), ("observation", "2"), ("assistant", "It is 2")]
    schema = "row_idx long, _prompt array<struct<role:string,content:string>>, _response array<struct<role:string,content:string>>, _system string, _tools string, n array<int>"
    plain = [("user", "hello"), ("assistant", "hi")]
    return spark.createDataFrame([(0, talk[:3], talk[3:], "Be kind", json.dumps([TOOL]), [2, 1]), (1, plain[:1], plain[1:], "", "", [])], schema)


@pytest.mark.parametrize("name", ["qwen", "default", "llama3", "mistral"])
def test_tools_and_calls_are_written_in_the_templates_format(spark, name):
    t = templates.get(name)
    texts = {r["row_idx"]: "".join(r["__text"]) for r in encode.rendered(rows(spark), t, whole_talk(), "</s>").collect()}
    today = spark.sql("SELECT date_format(current_date(), 'dd MMM yyyy')").first()[0]
    assert tools.tool_prompt(json.dumps([TOOL]), t.tools, today) in texts[0]
    assert tools.call_text(CALL, t.tools) in texts[0] and CALL not in texts[0].replace(tools.call_text(CALL, t.tools), "")
    plain = encode.rendered(rows(spark).filter("row_idx = 1"), t, whole_talk(), "</s>", encode.Extras(tools=False))
    assert texts[1] == "".join(plain.first()["__text"])


def test_tools_reach_the_ids(spark):
    out = {r["row_idx"]: r for r in encode.supervised(rows(spark), "qwen", DataArgs(cutoff_len=500)).collect()}
    whole = encode.rendered(rows(spark), templates.get("qwen"), whole_talk(), "</s>").select("row_idx", F.flatten(F.transform("__text", tokenizer("whitespace"))).alias("ids")).collect()
    assert {r["row_idx"]: r["ids"] for r in whole} == {i: r["input_ids"] for i, r in out.items()}


def test_rows_without_tools_need_no_python(spark):
    plan = encode.supervised(rows(spark), "qwen", DataArgs(cutoff_len=50), extras=encode.Extras(tools=False))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_media_in_rows(spark):
    df = rows(spark, "<image> and <image>").filter("row_idx = 0")
    text = lambda name, counts: "".join(encode.rendered(df, templates.get(name), whole_talk(), "</s>", encode.Extras(media={"image": counts})).first()["__text"])
    assert "<|vision_start|><|image_pad|><|image_pad|><|vision_end|> and <|vision_start|><|image_pad|><|vision_end|>" in text("qwen2_vl", F.col("n"))
    grid = F.array(*(F.struct(F.lit(r).alias("rows"), F.lit(c).alias("columns")) for r, c in ((2, 3), (1, 1))))
    assert "[IMG][IMG][IMG][IMG_BREAK][IMG][IMG][IMG][IMG_END] and [IMG][IMG_END]" in text("pixtral", grid)
    assert "(<image>./</image>) and (<image>./</image>)" in text("minicpm_v", F.col("n"))
    tiles = F.array(*(F.struct(F.lit(r).alias("rows"), F.lit(c).alias("columns"), F.lit(2).alias("patches")) for r, c in ((1, 2), (1, 1))))
    p = "<|patch|><|patch|>"
    assert (
        f"<|image_start|>{p}<|tile_x_separator|>{p}<|tile_y_separator|><|image|>{p}<|image_end|> and <|image_start|><|image|>{p}<|image_end|>"
        in df.select(media.process(F.col("_prompt"), "llama4", image=tiles)[0]["content"].alias("t")).first()["t"]
    )


def test_images_in_front(spark):
    front = media.leading_ids("paligemma", F.col("n"), 3, 77)
    out = encode.supervised(rows(spark), "paligemma", DataArgs(cutoff_len=500), extras=encode.Extras(front=front)).orderBy("row_idx").collect()
    assert out[0]["input_ids"][:7][:6] == [77] * 6 and out[0]["labels"][:6] == [-100] * 6 and 77 not in out[1]["input_ids"]
    assert len(out[0]["input_ids"]) == len(out[0]["labels"]) == len(out[0]["attention_mask"])


def test_calls_found_in_answers():
    assert tools.extract_calls('Action: f\nAction Input: {"a": 1}\nAction: g_2\nAction Input: `{"b": "x"}`\n', "default") == [("f", '{"a": 1}'), ("g_2", '{"b": "x"}')]
    assert tools.extract_calls("Action: no input", "default") is None and tools.extract_calls("text", "qwen") is None
    two = '<tool_call>\n{"name": "f", "arguments": {}}\n</tool_call>\n<tool_call>\n{"name": "g", "arguments": {"t": "</tool_call> x"}}\n</tool_call>'
    assert tools.extract_calls(two, "qwen") == [("f", "{}"), ("g", '{"t": "</tool_call> x"}')]
