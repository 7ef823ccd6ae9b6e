"""Preparation from a catalogue to encoded splits: dispatch by stage, sampling, mixing, splitting, storing, command line."""

import hashlib
import json

import pandas as pd
import pytest
from corpusloom import __main__ as command
from corpusloom.config import DataArgs, DatasetSpec, RunSpec
from corpusloom.operators import encode, prepare
from corpusloom.operators.prepare import Module
from pyspark.sql import functions as F

PLAIN = encode.Extras(tools=False)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("catalogue")
    info = {
        "ask": {"file_name": "ask.jsonl"}, "more": {"file_name": "more"}, "few": {"file_name": "ask.jsonl", "num_samples": 9}, "many": {"file_name": "ask.jsonl", "num_samples": 45},
        "pairs": {"file_name": "pairs.json", "ranking": True, "columns": {"prompt": "q", "chosen": "good", "rejected": "bad"}},
        "text": {"file_name": "text.txt", "columns": {"prompt": "value"}}, "far": {"hf_hub_url": "x/y"},
    }
    (at / "dataset_info.json").write_text(json.dumps(info))
    row = lambda i: json.dumps({"instruction": f"question {i}", "input": "", "output": f"answer {i} is long"})
    (at / "ask.jsonl").write_text("\n".join(row(i) for i in range(30)))
    (at / "more").mkdir()
    for k in range(3):
        (at / "more" / f"{k}.jsonl").write_text("\n".join(row(100 + 10 * k + i) for i in range(10)))
    (at / "pairs.json").write_text(json.dumps([{"q": f"q {i}", "good": "yes it is so", "bad": "no"} for i in range(8)]))
    (at / "text.txt").write_text("\n".join(f"line {i} of text" for i in range(50)))
    return str(at)


def word(w):
    return int(hashlib.md5(w.encode()).hexdigest()[:7], 16)


def numbers(df, column="labels"):
    """Which of the rows "answer i is long" are there: by the id of their number."""
    known = {word(str(i)): i for i in range(200)}
    return [known[x] for r in df.orderBy("row_idx").collect() for x in r[column] if x in known]


def args(*names, **more):
    return DataArgs(datasets=names, **more)


def test_concatenation_numbers_all_sources(spark, folder):
    got = prepare.prepare(spark, RunSpec(), args("ask", "more"), folder, extras=PLAIN)
    rows = got.train.orderBy("row_idx").collect()
    assert [r["row_idx"] for r in rows] == list(range(60)) and got.evaluation is None
    assert numbers(got.train) == [*range(30), *range(100, 130)]
    assert rows[0]["labels"][: rows[0]["labels"].index(word("answer"))] == [-100] * rows[0]["labels"].index(word("answer"))


def test_samples_are_drawn_before_alignment(spark, folder):
    few = prepare.prepare(spark, RunSpec(), args("few", "more"), folder, extras=PLAIN).train
    assert few.count() == 39 and len(set(numbers(few))) == 39
    many = numbers(prepare.prepare(spark, RunSpec(), args("many"), folder, extras=PLAIN).train)
    assert len(many) == 45 and set(many) == set(range(30))
    capped = numbers(prepare.prepare(spark, RunSpec(), args("ask", "more", max_samples=4), folder, extras=PLAIN).train)
    assert capped == [0, 1, 2, 3, 100, 101, 102, 103]
    # the conversion runs on what is left of the scan
    rows = prepare.merged(prepare.resolve(spark, ("few",), folder, None), RunSpec(), args("few"), folder)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("_prompt") < plan.rindex("Window")


def test_interleaving_takes_turns(spark, folder):
    got = numbers(prepare.prepare(spark, RunSpec(), args("ask", "more", mix_strategy="interleave_under"), folder, extras=PLAIN).train)
    assert got == [x for i in range(30) for x in (i, 100 + i)]


def test_validation_is_exact_and_apart(spark, folder):
    for size, n in ((7, 7), (0.1, 6), (0.01, 1), (100, 60)):
        module = prepare.prepare(spark, RunSpec(), args("ask", "more", val_size=size), folder, extras=PLAIN)
        a, b = ({r["row_idx"] for r in t.collect()} for t in (module.train, module.evaluation))
        assert len(b) == n and not a & b and a | b == set(range(60))
        want = sorted(range(60), key=lambda i: hashlib.md5(f"42-{i}".encode()).hexdigest())[:n]
        assert b == set(want)


def test_stages_have_processors(spark, folder):
    sft = prepare.prepare(spark, RunSpec(), args("ask", packing=True, neat_packing=True, cutoff_len=65), folder, extras=PLAIN).train.collect()
    assert {len(r["input_ids"]) for r in sft} == {65} and sum(sum(x == 1 for x in r["position_ids"]) for r in sft) == 30
    rm = prepare.prepare(spark, RunSpec("rm"), args("pairs"), folder, extras=PLAIN).train
    assert rm.count() == 8 and {"chosen_input_ids", "rejected_labels"} <= set(rm.columns)
    blocks = prepare.prepare(spark, RunSpec("pt"), args("text", cutoff_len=16), folder).train.collect()
    assert len(blocks) == 50 * 5 // 16 and {len(r["input_ids"]) for r in blocks} == {16}
    apart = prepare.prepare(spark, RunSpec("pt", add_bos=True), args("text", packing=False, cutoff_len=4), folder).train.orderBy("row_idx").collect()
    assert len(apart) == 50 and {len(r["input_ids"]) for r in apart} == {4} and apart[0]["input_ids"][0] == encode.BOS_ID
    made = prepare.prepare(spark, RunSpec("ppo"), args("ask"), folder, extras=PLAIN).train.first()
    assert word("question") in made["input_ids"] and word("answer") not in made["input_ids"] and word("answer") in made["labels"]
    with pytest.raises(ValueError, match="exists"):
        prepare.register_stage("sft", lambda *a: None)


def test_evaluation_sets(spark, folder):
    own = DataArgs(datasets=("ask",), eval_datasets=("more", "few"))
    both = prepare.prepare(spark, RunSpec(evaluate=True), own, folder, extras=PLAIN)
    assert both.evaluation.count() == 39
    apart = prepare.prepare(spark, RunSpec(predict=True, generate=True), own, folder, extras=PLAIN)
    assert {k: v.count() for k, v in apart.splits().items()} == {"train": 30, "validation_more": 30, "validation_few": 9}
    assert word("answer") not in apart.evaluation["more"].first()["input_ids"] and word("answer") in apart.train.first()["input_ids"]


def test_stored_rows_are_taken(spark, folder, tmp_path):
    run = RunSpec(tokenized=f"file://{tmp_path}/t")
    first = prepare.prepare(spark, run, args("ask", val_size=5), folder, extras=PLAIN)
    again = prepare.prepare(spark, run, args("no such dataset"), "/nowhere")
    assert {k: v.count() for k, v in again.splits().items()} == {k: v.count() for k, v in first.splits().items()} == {"train": 25, "validation": 5}
    assert Module.of({"validation_a": again.train, "other": again.train}).splits().keys() == {"validation_a"}


def test_rows_at_hand_and_files_are_numbered(spark, folder):
    rows = spark.range(10_000).repartition(7).select(F.concat(F.lit("t "), "id").alias("value"))
    out = prepare.positioned(rows)
    assert sorted(r["row_idx"] for r in out.collect()) == list(range(10_000))
    kept = prepare.positioned(spark.read.text(f"{folder}/text.txt"))
    assert [r["value"] for r in kept.orderBy("row_idx").collect()] == [f"line {i} of text" for i in range(50)]


def test_what_excludes_itself(spark, folder):
    bad = [
        (RunSpec("rm"), args("ask"), "ranking"), (RunSpec("kto"), args("pairs"), "ranking"), (RunSpec("pt"), args("text", mask_history=True), "sft"), (RunSpec("kto", generate=True), args("ask"), "sft"),
        (RunSpec(predict=True), args("ask"), "generate"), (RunSpec(evaluate=True), args("ask"), "evaluate"), (RunSpec(), DataArgs(), "dataset"), (RunSpec(), args("nothing"), "undefined"),
        (RunSpec("rm"), args("pairs", neat_packing=True), "neatly"), (RunSpec("ppo", train=False), args("ask"), "trains"), (RunSpec(), args("ask", streaming=True, max_steps=5), "stream"),
    ]
    for run, a, text in bad:
        with pytest.raises(ValueError, match=text):
            prepare.prepare(spark, run, a, folder)
    with pytest.raises(NotImplementedError):
        prepare.prepare(spark, RunSpec(), args("far"), folder)
    with pytest.raises(ValueError, match="unknown stage"):
        RunSpec("dpo")
    empty = {"none": (DatasetSpec("none"), spark.createDataFrame([], "instruction string, input string, output string"))}
    with pytest.raises(RuntimeError, match="valid row"):
        prepare.prepare(spark, RunSpec(), args("none"), tables=empty, extras=PLAIN)


def test_command_line(spark, folder, tmp_path):
    spec = tmp_path / "spec.json"
    spec.write_text(json.dumps({"run": {"stage": "sft"}, "args": {"datasets": ["ask"], "val_size": 3}, "folder": folder}))
    out = f"file://{tmp_path}/out"
    assert command.main(["prepare", str(spec), "args.cutoff_len=8", "run.template=qwen", f"output={out}"], spark) == {"train": 27, "validation": 3}
    assert spark.read.parquet(f"{out}/train").selectExpr("max(size(input_ids)) as n").first()["n"] == 8
    assert command.main(["datasets", str(spec)], spark)["ask"]["formatting"] == "alpaca"
    with pytest.raises(NotImplementedError):
        command.main(["train", str(spec)], spark)
    with pytest.raises(ValueError, match="has no"):
        command.main(["prepare", str(spec), "args.colour=1"], spark)


def test_a_divided_run_tokenizes_twice(spark):
    """Once for the blocks' numbers and once for the result, whatever is asked about the numbers."""
    from corpusloom.functions.tokens import register_tokenizer

    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<int>")
    def counted(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts.map(lambda t: [len(w) for w in t.split()])

    register_tokenizer("counted", counted)
    rows = spark.createDataFrame([(i, f"some words of text {i} " * 9) for i in range(300)], "row_idx long, text string")
    args = DataArgs(cutoff_len=16, val_size=0.1, datasets=("a",))
    module = prepare.prepare(spark, RunSpec("pt", tokenizer="counted"), args, tables={"a": (DatasetSpec("a", columns={"prompt": "text"}), rows)})
    marked = sorted((r["row_idx"], r["split"]) for r in module.marked.select("row_idx", "input_ids", "split").collect())
    assert seen.value == 600
    assert marked == sorted((r["row_idx"], k) for k, t in module.splits().items() for r in t.select("row_idx").collect())
    assert sum(k == "validation" for _, k in marked) == -(-len(marked) // 10)
