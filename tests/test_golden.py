"""Known results, written as literals, on small tables."""

import pytest
from corpusloom.config import DataArgs, DatasetSpec, check_stage
from corpusloom.functions import media, svg, templates, tokens, tools
from corpusloom.operators import align, encode, evaluate, mix, pack, stats
from corpusloom.sources import catalog
from pyspark.sql import functions as F


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(("s", "t", "cut", "want"), [
    (3000, 2000, 1000, (600, 400)), (2000, 3000, 1000, (400, 600)), (1000, 100, 1000, (900, 100)), (100, 1000, 1000, (100, 900)),
    (100, 500, 1000, (100, 500)), (500, 100, 1000, (500, 100)), (10, 10, 1000, (10, 10)),
])
def test_infer_seqlen(spark, s, t, cut, want):
    a, b = tokens.infer_seqlen(F.lit(s), F.lit(t), cut)
    assert rows(spark.range(1).select(a, b)) == [want]


def test_alpaca_alignment(spark):
    df = spark.createDataFrame([("Solve the math problem.", "3 + 4", "The answer is 7.")], "instruction string, input string, output string")
    r = align.align(df, DatasetSpec("x")).first()
    assert [tuple(m) for m in r["_prompt"]] == [("user", "Solve the math problem.\n3 + 4")]
    assert [tuple(m) for m in r["_response"]] == [("assistant", "The answer is 7.")]
    assert (r["_system"], r["_tools"], r["_images"], r["_videos"], r["_audios"]) == ("", "", None, None, None)


def test_sharegpt_alignment(spark):
    talk = [("system", "You are a helpful assistant."), ("human", "Solve the math problem.\n3 + 4"), ("gpt", "The answer is 7.")]
    broken = [("human", "a"), ("human", "b")]
    df = spark.createDataFrame([(talk,), (broken,), ([],), ([("human", "a")],)], "conversations array<struct<from:string,value:string>>")
    out = align.align(df, DatasetSpec("x", formatting="sharegpt", columns={"messages": "conversations"})).collect()
    assert out[0]["_system"] == "You are a helpful assistant."
    assert [tuple(m) for m in out[0]["_prompt"]] == [("user", "Solve the math problem.\n3 + 4")]
    assert [tuple(m) for m in out[0]["_response"]] == [("assistant", "The answer is 7.")]
    assert all(r["_prompt"] == [] and r["_response"] == [] for r in out[1:])


def test_preference_and_ranking_alignment(spark):
    df = spark.createDataFrame([("q", "", "yes", True), ("q", "", "no", False), ("q", "", "none", None)], "instruction string, input string, output string, tag boolean")
    spec = DatasetSpec("x", columns={"prompt": "instruction", "query": "input", "response": "output", "kto_tag": "tag"})
    got = [[m["content"] for m in r["_response"]] for r in align.align(df, spec).collect()]
    assert got == [["yes", ""], ["", "no"], ["none"]]
    ranked = spark.createDataFrame([("q", "good", "bad")], "instruction string, chosen string, rejected string")
    r = align.align(ranked, DatasetSpec("x", ranking=True, columns={"prompt": "instruction", "chosen": "chosen", "rejected": "rejected"})).first()
    assert [m["content"] for m in r["_response"]] == ["good", "bad"]


def test_packed_sequence_helpers(spark):
    df = spark.createDataFrame([([1, 1, 2, 2, 2, 0],), ([1, 2, 2, 3, 3, 3],)], "m array<int>")
    assert [x for (r,) in rows(df.select(tokens.sequence_lengths(F.col("m")))) for x in r] == [2, 3, 1, 2, 3]
    assert rows(spark.range(1).select(tokens.cumulative(F.array(*map(F.lit, (2, 3, 1, 2, 3)))))) == [([0, 2, 5, 6, 8, 11],)]
    mask = rows(df.select(tokens.block_causal_mask(F.col("m"))))[0][0]
    assert mask == [[1, 0, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0], [0, 0, 1, 1, 0, 0], [0, 0, 1, 1, 1, 0], [0, 0, 0, 0, 0, 0]]


def test_padding_and_rotation(spark):
    df = spark.createDataFrame([(0, [0, 1, 2, 3, 4, 5]), (0, [6, 7])], "batch_id int, ids array<int>")
    assert sorted(rows(tokens.padded(df, "ids", 9, "batch_id", 8).select("ids"))) == [([0, 1, 2, 3, 4, 5, 9, 9],), ([6, 7, 9, 9, 9, 9, 9, 9],)]
    assert rows(spark.range(1).select(tokens.rotated(F.array(*map(F.lit, (0, 0, 5, 0, 6))), 0))) == [([5, 0, 6, 0, 0],)]


def test_supervised_fold_against_plain_python(spark):
    import random

    r = random.Random(0)
    talks = [[([r.randint(5, 99) for _ in range(r.randint(1, 30))], [r.randint(5, 99) for _ in range(r.randint(1, 30))]) for _ in range(r.randint(1, 5))] for _ in range(40)]

    def plain(pairs, cut, history, eos):
        ids, labels, used = [], [], int(eos)
        for k, (s, t) in enumerate(pairs[::-1] if history else pairs):
            if used >= cut:
                break
            left = cut - used
            n = left if len(t) * 2 < left else left - len(s) if len(s) * 2 < left else int(left * (len(t) / (len(s) + len(t))))
            n = min(n, len(t))
            m = min(max(left - n, 0), len(s))
            a, b = s[:m], t[:n]
            used += m + n
            la = [2] + [-100] * (m - 1) if eos else [-100] * m
            lb = [-100] * n if history and k else b
            ids, labels = (a + b + ids, la + lb + labels) if history else (ids + a + b, labels + la + lb)
        return (ids + [2] * eos, labels + [2] * eos)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(talks)], "i int, p array<struct<source:array<int>,target:array<int>>>")
    for history in (False, True):
        for eos in (False, True):
            e = encode.fold_turns(F.col("p"), DataArgs(cutoff_len=50, mask_history=history), eos)
            got = rows(df.withColumn("e", e).orderBy("i").select("e.ids", "e.labels"))
            assert got == [plain(t, 50, history, eos) for t in talks]


def test_knapsack_and_assembly(spark):
    assert pack.greedy_bins([4, 3, 2, 1], 5) == [0, 1, 1, 0]
    with pytest.raises(ValueError, match="capacity"):
        pack.greedy_bins([6], 5)
    df = spark.createDataFrame([(0, i, [i] * n, [i] * n) for i, n in enumerate([4, 3, 2, 1])], "batch_id long, row_idx long, input_ids array<int>, labels array<int>")
    out = {r["bin"]: r for r in pack.assembled(pack.knapsack(df, 5), 5, neat=True).collect()}
    assert out[0]["input_ids"] == [0, 0, 0, 0, 3, 0] and out[0]["labels"] == [0, 0, 0, 0, 3, -100]
    assert out[0]["attention_mask"] == [1, 1, 1, 1, 2, 0] and out[0]["position_ids"] == [0, 1, 2, 3, 0, 0]
    loose = {r["bin"]: r for r in pack.assembled(pack.knapsack(df, 5), 5, neat=False).collect()}
    assert loose[0]["attention_mask"] == [1] * 6


def test_templates(spark):
    m = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("user", "How are you"), ("assistant", "I am fine!"), ("user", "{{content}}"), ("assistant", "ok"))))
    shown = lambda n, system=None: spark.range(1).select(templates.turns(templates.get(n), m, system, bos="<s>", eos="</s>")).first()[0]
    head = "<|start_header_id|>{}<|end_header_id|>\n\n"
    user = head.format("user") + "How are you<|eot_id|>" + head.format("assistant")
    assert shown("llama3")[:2] == ["<s>" + user, "I am fine!<|eot_id|>"]
    assert shown("llama2", F.lit("sys"))[0] == "<s>[INST] <<SYS>>\nsys\n<</SYS>>\n\nHow are you [/INST]"
    assert shown("chatglm2")[2].startswith("[Round 1]\n\n问：{{content}}")
    assert shown("empty")[1] == "I am fine!"
    assert len(templates.names()) >= 87
    with pytest.raises(ValueError, match="does not exist"):
        templates.get("nothing")
    assert templates.stop_words(templates.get("chatml"), "</s>") == ("<|im_end|>", ["<|im_start|>"])
    assert 'PARAMETER stop "<|im_end|>"' in templates.modelfile(templates.get("qwen"))
    assert "message['role'] == 'user'" in templates.jinja(templates.get("llama2"), "<s>", "</s>")


TOOL = '[{"name": "test_tool", "description": "tool_desc", "parameters": {"type": "object", "properties": {"foo": {"type": "string", "description": "foo_desc"}, "bar": {"type": "number", "description": "bar_desc"}}, "required": ["foo"]}}]'


def test_tools(spark):
    text = tools.tool_prompt(TOOL, "default")
    assert "> Tool Name: test_tool\nTool Description: tool_desc\nTool Args:\n  - foo (string, required): foo_desc\n  - bar (number): bar_desc\n\n" in text
    assert text.endswith("```\n") and "(one of [test_tool])" in text
    call = '{"name": "tool_name", "arguments": {"foo": "bar", "size": 10}}'
    want = {
        "default": 'Action: tool_name\nAction Input: {"foo": "bar", "size": 10}\n', "glm4": 'tool_name\n{"foo": "bar", "size": 10}',
        "llama3": '{"name": "tool_name", "parameters": {"foo": "bar", "size": 10}}', "mistral": '[{"name": "tool_name", "arguments": {"foo": "bar", "size": 10}}]',
        "qwen": '<tool_call>\n{"name": "tool_name", "arguments": {"foo": "bar", "size": 10}}\n</tool_call>',
    }
    for name, shown in want.items():
        assert tools.call_text(call, name) == shown
        assert tools.extract_calls(shown, name) == [("tool_name", '{"foo": "bar", "size": 10}')]
        assert tools.extract_calls("plain words", name) is None
    assert tools.call_text(f"<think>hm</think>{call}", "qwen").startswith("<think>hm</think><tool_call>")
    with pytest.raises(ValueError, match="one call"):
        tools.call_text(f"[{call}, {call}]", "glm4")
    df = spark.createDataFrame([(want["qwen"],), ("plain",), (None,)], "t string")
    assert [r[0] and [tuple(c) for c in r[0]] for r in df.select(tools.calls_column(F.col("t"), "qwen")).collect()] == [[("tool_name", '{"foo": "bar", "size": 10}')], None, None]


DRAWING = (
    '<svg xmlns="http://www.w3.org/2000/svg"><linearGradient id="g"><stop offset="0" stop-color="#102030"/></linearGradient>'
    '<g fill="#ff0000"><circle cx="50" cy="50.256" r="40"/></g><path d="m10 10 l5,5 z" fill="url(#g)"/><path d="M1 1"/></svg>'
)


def test_svg_steps():
    assert svg.number_text("2.675") == "2.67" and svg.number_text("3.0") == "3"
    assert svg.path_text("m1 2 l-3.456,4z") == "[m]1 2 [l]-3.46 4 [z]"
    text = svg.flatten_gradients(DRAWING)
    assert 'd="m10 10 l5,5 z" fill="#102030"' in text and 'd="M1 1" fill="#102030"' in text and "Gradient" not in text
    assert "<g" not in svg.flatten_groups(DRAWING) and 'fill="#ff0000"' in svg.flatten_groups(DRAWING)
    assert svg.strip_svg('<svg xmlns="http://www.w3.org/2000/svg"><rect width="1"/></svg>') == '<rect width="1" />'
    structure, out = svg.encode(text)
    assert structure.startswith("<svg>\n  <g> (_{'fill': '#ff0000'}_)\n    <circle>\n      _cx_50 _cy_50.26 _r_40 _fill_#ff0000 \n")
    assert "[<|svg_path|>][<|path_d|>][<|moveto|>]10 10[<|lineto|>]5 5[<|close_the_path|>][<|fill|>]#102030" in out
    assert svg.decode(out).count("<path") == 2
    assert svg.prepared("no markup")[0] == "no markup" and svg.prepared("no markup")[2]
    cyc = '<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink"><radialGradient id="a" xlink:href="#b"/><radialGradient id="b" xlink:href="#a"/><path d="m1 1" fill="url(#a)"/></svg>'
    assert "url(#a)" in svg.flatten_gradients(cyc)


def test_svg_columns(spark):
    df = spark.createDataFrame([(DRAWING,), ("<svg",), (None,)], "svg_code string")
    out = svg.prepare(df, debug=True).collect()
    assert out[0]["error"] is None and out[0]["svg_raw"] == DRAWING and out[1]["svg_text"] == "<svg" and out[1]["error"] and out[2]["svg_text"] is None
    one = spark.range(1)
    assert rows(one.select(svg.mean_colour(F.array(F.lit("#000000"), F.lit("#0102ff"))))) == [("#00017f",)]
    assert rows(one.select(svg.rgb(F.lit("#zz0000")))) == [(None,)]
    assert rows(one.select(svg.trimmed(F.lit("a</svg>b")))) == [("a</svg>",)]


def test_media(spark):
    m = F.array(*(F.struct(F.lit("user").alias("role"), F.lit(c).alias("content")) for c in ("<image>a", "b<image>")))
    out = rows(spark.range(1).select(media.process(m, "llava", image=F.array(F.lit(2), F.lit(1)))))[0][0]
    assert [x["content"] for x in out] == ["<image><image>a", "b<image>"]
    with pytest.raises(Exception, match="does not match"):
        spark.range(1).select(media.process(m, "llava", image=F.array(F.lit(2)))).collect()
    with pytest.raises(ValueError, match="takes no"):
        media.check_support("llava", {"audio"})
    assert rows(spark.range(1).select(media.grid_text(F.lit(32), F.lit(48), 16, "I", "b", "e"))) == [("IIIbIIIe",)]


def test_benchmark_prompt(spark):
    schema = "item_id long, subject string, question string, A string, B string, C string, D string, answer string"
    test = spark.createDataFrame([(1, "math", "test question", "test1", "test2", "test3", "test4", "A")], schema)
    dev = spark.createDataFrame([(2, "math", "example question", "e1", "e2", "e3", "e4", "B")], schema)
    r = evaluate.few_shot(test, dev, 1).first()
    assert [tuple(m) for m in r["messages"]] == [
        ("user", "The following are multiple choice questions (with answers) about math.\n\nexample question\nA. e1\nB. e2\nC. e3\nD. e4\nAnswer:"),
        ("assistant", "B"), ("user", "test question\nA. test1\nB. test2\nC. test3\nD. test4\nAnswer:"),
    ]


def test_overlap_scores():
    assert evaluate.bleu4("abcdef", "abcdef") == 100.0 and evaluate.bleu4("", "a") == 0.0
    assert evaluate.rouge("a b c", "a b c") == (100.0, 100.0, 100.0) and evaluate.rouge("", "a") == (0.0, 0.0, 0.0)


def test_durations(spark):
    df = spark.createDataFrame([(3661,), (90061,), (180000,)], "s long")
    assert rows(df.select(stats.duration(F.col("s")))) == [("1:01:01",), ("1 day, 1:01:01",), ("2 days, 2:00:00",)]


def test_configuration_checks():
    for bad in (
        {"val_size": 0.1}, {"datasets": ("a",), "eval_datasets": ("b",), "val_size": 0.1}, {"interleave_probs": (1.0,)}, {"streaming": True, "max_steps": 1, "max_samples": 3},
        {"streaming": True}, {"mask_history": True, "train_on_prompt": True}, {"mix_strategy": "?"}, {"mix_strategy": "interleave_over", "interleave_probs": (0.5, 0.5), "datasets": ("a",)},
    ):
        with pytest.raises(ValueError):
            DataArgs(**bad)
    assert DataArgs(neat_packing=True).capacity == 2047
    with pytest.raises(ValueError):
        check_stage("rm", False)
    with pytest.raises(ValueError):
        check_stage("sft", True)


def test_catalogue(spark, tmp_path):
    (tmp_path / "dataset_info.json").write_text('{"a": {"file_name": "a.jsonl", "columns": {"prompt": "q"}}, "h": {"hf_hub_url": "x/y", "file_name": "z"}}')
    (tmp_path / "a.jsonl").write_text('{"q": "hello"}\n')
    a, h = catalog.datasets(spark, ["a", "h"], str(tmp_path))
    assert a.column("prompt") == "q" and a.column("response") is None and h.source == "hub"
    assert rows(catalog.load(spark, a, str(tmp_path))) == [("hello",)]
    with pytest.raises(ValueError, match="undefined"):
        catalog.datasets(spark, ["b"], str(tmp_path))
    with pytest.raises(NotImplementedError):
        catalog.load(spark, h)
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    (mixed / "a.csv").write_text("x\n1\n")
    (mixed / "b.json").write_text("[]")
    with pytest.raises(ValueError, match="one kind"):
        catalog.scan(spark, str(mixed))


def test_builders(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text('{"id": 1, "data": ["a", "b", "c"]}\nbroken\n{"id": 2, "data": ["x"]}\n')
    assert [[t["from"] + t["value"] for t in r[0]] for r in catalog.ultra_chat(spark, str(tmp_path / "u.jsonl")).collect()] == [["humana", "gptb"]]
    (tmp_path / "b.jsonl").write_text('{"instruction": "Human:q1\\nAssistant:a1\\nHuman:q2\\nAssistant:", "output": "a2"}\n')
    assert [t["value"] for t in catalog.belle_multiturn(spark, str(tmp_path / "b.jsonl")).first()[0]] == ["q1", "a1", "q2", "a2"]
    (tmp_path / "h.jsonl").write_text('{"chosen": "\\n\\nHuman: q1\\n\\nAssistant: a1\\n\\nHuman: q2\\n\\nAssistant: good", "rejected": "\\n\\nHuman: q1\\n\\nAssistant: a1\\n\\nHuman: q2\\n\\nAssistant: bad"}\n')
    assert tuple(catalog.hh_rlhf(spark, str(tmp_path / "h.jsonl")).first()) == ("q2", "good", "bad", [["q1", "a1"]])


def test_arrow_scan(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"a": [1, 2], "b": ["x", None]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t)
    assert sorted(rows(catalog.scan(spark, str(tmp_path / "t.arrow")))) == [(1, "x"), (2, None)]


def test_positions(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "k long")
    assert sorted(rows(mix.numbered(df, "k"))) == [(1, 0), (3, 1), (5, 2), (9, 3)]
    t = mix.numbered(df, "k")
    w = mix.interleaved([t, t], "interleave_over", [0.5, 0.5], 1)
    assert w.select("src_idx", "row_idx").distinct().count() == 8  # every row of both
