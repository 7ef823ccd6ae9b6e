"""Running sums and smoothing in stretches, chunks by piece, zipping, set operations, sinks, CSV over lines."""

import random

import pytest
from corpusloom.functions import tokens
from corpusloom.operators import align, encode, evaluate, mix, stats
from corpusloom.sources import catalog, sinks
from pyspark.sql import functions as F


def test_running_sums_over_stretches(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, 1.5, -2.0, 7.0])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    for key in ("k", None):
        so_far, want = {}, {}
        for k, i, v in rows:
            own = k if key else 0
            s, n = so_far.get(own, (None, 0))
            so_far[own] = (s if v is None else (s or 0.0) + v, n + (v is not None))
            want[i] = so_far[own]
        got = {x["i"]: (x["sum"], x["count"]) for x in stats.running(df, "i", "v", key, stretch=50).collect()}
        assert got == want


def test_smoothing_over_stretches(spark):
    rows = [("a", i, float(i % 11)) for i in range(700)] + [(None, i, 2.0 * i) for i in range(90)] + [("c", 0, 5.0)]
    got = {(r["k"], r["i"]): r["smoothed"] for r in stats.smoothed(spark.createDataFrame(rows, "k string, i int, v double"), "k", "i", "v", stretch=64).collect()}
    assert len(got) == len(rows)
    for key in ("a", None, "c"):
        own = [v for k, _, v in rows if k == key]
        w = 1.8 * (1 / (1 + 2.718281828459045 ** (-0.05 * len(own))) - 0.5)
        last = own[0]
        for i, v in enumerate(own):
            last = last * w + (1 - w) * v
            assert got[key, i] == pytest.approx(last)


def test_weighted_turns_in_stretches(spark, monkeypatch):
    tables = [spark.range(n).select(F.col("id").alias("row_idx"), F.lit(s).alias("s")) for n, s in ((60, "a"), (45, "b"))]
    for strategy in ("interleave_under", "interleave_over"):
        want = sorted(map(str, mix.interleaved(tables, strategy, [0.6, 0.4]).collect()))
        monkeypatch.setattr(mix, "STRETCH", 7)
        assert sorted(map(str, mix.interleaved(tables, strategy, [0.6, 0.4]).collect())) == want
        monkeypatch.undo()


@pytest.mark.parametrize("bos", [None, 9])
def test_chunks_equal_a_plain_cut(spark, bos):
    r = random.Random(2)
    rows = [(b, i, [r.randint(10, 99) for _ in range(r.choice((0, 1, 3, 8, 9, 40)))]) for b in range(3) for i in range(r.randint(0, 12))] + [(7, 0, [1] * 8)]
    out = {(x["batch_id"], x["block"]): x["input_ids"] for x in encode.chunks(spark.createDataFrame(rows, "batch_id long, row_idx long, input_ids array<int>"), 8, bos_id=bos).collect()}
    want = {}
    for b in {x[0] for x in rows}:
        flat = [t for c, _, ids in sorted(rows, key=lambda x: x[:2]) if c == b for t in ids]
        for k in range(len(flat) // 8):
            block = flat[8 * k : 8 * k + 8]
            want[b, k] = block if bos is None else [bos, *block[1:]]
    assert out == want


def test_item_lengths_and_sets(spark):
    df = spark.createDataFrame([([1, 1, 2, 0],), ([3, 1, 3, 1, 1],), ([0, 0],), ([],)], "m array<int>")
    assert [r[0] for r in df.select(tokens.sequence_lengths(F.col("m"))).collect()] == [[2, 1], [3, 2], [], []]
    sets = spark.createDataFrame([([3, 1, 3, 2], [2, 5, 5])], "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    assert sets.select(tokens.without(a, b), tokens.joined(a, b), tokens.within(a, b), tokens.within(tokens.without(a, b), a)).first()[:] == ([3, 1], [3, 1, 2, 5], False, True)


def test_zipped_tables_have_one_length(spark):
    t = lambda n, c: spark.range(n).select(F.col("id").alias("row_idx"), F.when(F.col("id") != 1, F.concat(F.lit(c), "id")).alias(c))
    got = sorted(map(tuple, evaluate.zipped(prompt=t(3, "p"), label=t(3, "l")).collect()))
    assert got == [(0, "p0", "l0"), (1, None, None), (2, "p2", "l2")]
    with pytest.raises(Exception, match="too few"):
        evaluate.zipped(prompt=t(3, "p"), label=t(2, "l")).collect()


def test_feedback_metrics_count_what_is_no_number(spark):
    rows = [(True, 1.0, -1.0), (True, float("nan"), -3.0), (True, None, -2.0), (False, 4.0, -8.0)]
    got = evaluate.feedback_metrics(spark.createDataFrame(rows, "t boolean, rewards double, logps double"), "t", ("rewards", "logps")).first()
    assert got.asDict() == {"rewards_chosen": pytest.approx(1 / 3), "logps_chosen": -2.0, "rewards_rejected": 4.0, "logps_rejected": -8.0, "rewards_margins": pytest.approx(1 / 3 - 4)}
    alone = evaluate.feedback_metrics(spark.createDataFrame(rows[:1], "t boolean, rewards double, logps double"), "t", ("rewards",)).first()
    assert alone["rewards_rejected"] is None and alone["rewards_margins"] is None


def test_columns_and_lengths(spark):
    df = spark.createDataFrame([([1, 2, 3], "x"), ([1], "y")], "input_ids array<int>, t string")
    assert align.only(df, "t").columns == ["t"] and align.not_longer(df, 2).count() == 1
    with pytest.raises(ValueError, match="at most"):
        align.not_longer(df, 0)
    with pytest.raises(ValueError, match="missing"):
        align.only(df, "u")


def test_csv_is_split_unless_a_record_goes_on(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two ""quoted"" words"\n3,four\n')
    (tmp_path / "b.csv").write_text('x,y\n1,"two\nlines"\n3,four\n')
    plain, over = (str(tmp_path / f"{n}.csv") for n in "ab")
    assert not catalog._over_lines(spark, [plain]) and catalog._over_lines(spark, [over])
    assert [r["y"] for r in catalog.scan(spark, plain).collect()] == ['two "quoted" words', "four"]
    assert [r["y"] for r in catalog.scan(spark, over).collect()] == ["two\nlines", "four"]


def test_score_logs_and_pretty_markup(spark, tmp_path):
    df = spark.createDataFrame([("Average", 50.0), ("STEM", 33.333)], "category string, accuracy double")
    sinks.save_scores(df, str(tmp_path / "log"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["Average: 50.00", "   STEM: 33.33"]
    svg = '<svg xmlns="http://www.w3.org/2000/svg"><g><path d="M0 0"/></g></svg>'
    rows = spark.createDataFrame([(svg,), ("<broken",), (None,)], "s string").select(sinks.pretty(F.col("s")).alias("p")).collect()
    assert rows[0]["p"].split("\n") == ['<svg xmlns="http://www.w3.org/2000/svg">', "  <g>", '    <path d="M0 0" />', "  </g>", "</svg>"]
    assert [r["p"] for r in rows[1:]] == ["<broken", None]
    with pytest.raises(Exception, match="exists"):
        sinks.save_scores(df, str(tmp_path / "log"))


def test_sinks_write_what_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("p", 'a "b" ü', "l"), ("q", "", None)], "prompt string, predict string, label string")
    sinks.save_predictions(rows, str(tmp_path / "p"))
    assert sorted(map(str, catalog.predictions(spark, str(tmp_path / "p")).collect())) == sorted(map(str, rows.collect()))
    split = spark.range(6).withColumn("split", F.when(F.col("id") < 2, "validation").otherwise("train"))
    sinks.save(split, str(tmp_path / "s"), by_split=True)
    assert spark.read.parquet(str(tmp_path / "s" / "split=validation")).count() == 2
    sinks.save_metrics(spark.createDataFrame([(2.5, 1)], "b double, a int"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()["value"] == '{"a":1,"b":2.5}'
    sinks.save_lines(rows, "prompt", str(tmp_path / "t"))
    assert sorted(r["line"] for r in catalog.lines(spark, str(tmp_path / "t")).collect()) == ["p", "q"]
    drawn = spark.createDataFrame([("one", "<svg/>"), ("two", None)], "name string, svg_text string")
    sinks.save_drawings(drawn, str(tmp_path / "d"))
    assert [(r["name"], r["value"]) for r in spark.read.text(str(tmp_path / "d")).collect()] == [("one", "<svg/>")]


def test_registered_counters_and_templates(spark):
    from corpusloom.functions import media

    sizes = spark.createDataFrame([([(336, 336, 8), (20, 5000, 1), None],)], "s array<struct<height:int,width:int,frames:int>>")

    def smart(h, w, unit=28, most=768 * 768, least=1024):
        a, b = max(unit, round(h / unit) * unit), max(unit, round(w / unit) * unit)
        if a * b > most:
            f = (h * w / most) ** 0.5
            a, b = max(unit, int(h / f / unit) * unit), max(unit, int(w / f / unit) * unit)
        elif a * b < least:
            f = (least / (h * w)) ** 0.5
            a, b = max(unit, -int(-h * f // unit) * unit), max(unit, -int(-w * f // unit) * unit)
        return a // 14 * (b // 14) // 4

    s = F.col("s")
    got = sizes.select(media.counts("qwen2_vl", "image", s), media.counts("llava", "image", s, media.Geometry(extra=1, drop_first=True)), media.counts("llava_next_video", "video", s), media.counts("qwen2_audio", "audio", s)).first()
    assert got[0] == [smart(336, 336), smart(20, 5000), None] and got[1] == [576, 357, None]
    assert got[2] == [576 // 4 * 8, 357 // 4, None] and got[3] == [(((8 - 1) // 2 + 1) - 2) // 2 + 1, 0, None]
    text = spark.createDataFrame([([("user", "<image> and <video>")], [(28, 56)], [(28, 28, 3)])], "m array<struct<role:string,content:string>>, i array<struct<height:int,width:int>>, v array<struct<height:int,width:int,frames:int>>")
    made = text.select(media.process_sizes(F.col("m"), "qwen2_vl", media.Geometry(), image=F.col("i"), video=F.col("v")).alias("o")).first()["o"][0]["content"]
    assert made == "<|vision_start|>" + "<|image_pad|>" * 2 + "<|vision_end|> and <|vision_start|>" + "<|video_pad|>" * 8 + "<|vision_end|>"
    with pytest.raises(ValueError, match="by size"):
        media.counts("mllama", "image", s)
    with pytest.raises(ValueError, match="exists"):
        media.register_counter("llava", "image", lambda m, g: m)
    evaluate.register_eval_template("xx", "On {subject}.\n", "\n{choice}) {content}", "\n=>")
    row = spark.createDataFrame([("q", "1", "2", "3", "4")], "question string, A string, B string, C string, D string")
    assert row.select(evaluate.question("xx")).first()[0] == "q\nA) 1\nB) 2\nC) 3\nD) 4\n=>"
    for bad in (("xx", "{subject}", "{choice}{content}"), ("yy", "none", "{choice}{content}")):
        with pytest.raises(ValueError):
            evaluate.register_eval_template(*bad, "")


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text('"What, then?\nTwo lines",a,b,c,d,A\nq2,1,2,3,4,D\n')
    assert [(r["question"], r["D"], r["answer"]) for r in catalog.mmlu(spark, str(tmp_path / "m.csv")).collect()] == [("What, then?\nTwo lines", "d", "A"), ("q2", "4", "D")]
    (tmp_path / "c.csv").write_text("id,question,A,B,C,D\n0,q,1,2,3,4\n")
    assert catalog.ceval(spark, str(tmp_path / "c.csv")).select("answer", "explanation", "question").first()[:] == ("", "", "q")
    (tmp_path / "cm.csv").write_text(",Question,A,B,C,D,Answer\n0,q,1,2,3,4,B\n")
    got = catalog.cmmlu(spark, str(tmp_path / "cm.csv")).first().asDict()
    assert got == {"question": "q", "A": "1", "B": "2", "C": "3", "D": "4", "answer": "B"}
    built = []
    stored = catalog.reload_or(spark, str(tmp_path / "none"), lambda: built.append(1) or spark.range(3))
    stored.write.parquet(str(tmp_path / "some"))
    assert built == [1] and catalog.reload_or(spark, str(tmp_path / "some"), lambda: 1 / 0).count() == 3 and catalog.reload_or(spark, None, lambda: spark.range(2)).count() == 2


def test_lookups_and_rotation(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "subject string, x int")
    table = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "subject string, category string")
    assert sorted(map(tuple, evaluate.categorised(rows.filter("subject is not null"), table).collect())) == [("a", 1, "A"), ("b", 2, "B")]
    for bad, t in ((rows, table), (rows.limit(2), table.union(table)), (rows.limit(2), table.limit(1))):
        with pytest.raises(Exception, match="no category|twice"):
            evaluate.categorised(bad, t).collect()
    ids = spark.createDataFrame([([0, 0, 5, 0, 6],), ([0, 0],), ([],), ([1, 0],), (None,)], "i array<int>")
    assert [r[0] for r in ids.select(tokens.rotated(F.col("i"), 0)).collect()] == [[5, 0, 6, 0, 0], [0, 0], [], [1, 0], None]
    new = spark.createDataFrame([("x",), ("y",), ("z",)], "token string")
    told = spark.createDataFrame([("x", [1, 1, 2]), ("y", [9])], "token string, description array<int>")
    vectors = spark.createDataFrame([(1, [0.0, 3.0]), (2, [3.0, 0.0])], "token_id int, embedding array<double>")
    got = {r["token"]: r["embedding"] for r in stats.described_embedding(new, told, vectors, lambda c: c).collect()}
    assert got == {"x": [1.0, 2.0], "y": None, "z": None}


def test_drawings_are_dealt_over_the_tasks(spark):
    """All parts lie in one block of one file; their markup is not one task's work."""
    from corpusloom.plans import graphics

    rows = graphics.svg_encode(spark, "/root/testdata/sf0.01")
    held = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(held) == tasks and max(held) < 1.3 * sum(held) / tasks


def test_pairs_are_ranked_without_their_texts(spark, tmp_path):
    """Ranks and pairs are made of ids; one join fetches the texts, and no window holds one."""
    from corpusloom.plans import conversations

    texts = spark.range(0, 400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("source"))
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(0, 400, 2).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, (F.col("id") % 4 == 0).cast("int")).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    pairs = conversations.pairs_by_source(spark, str(tmp_path))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    windows = [i for i, line in enumerate(lines) if "Window [row_number" in line]
    assert windows and not any("text#" in line for i in windows for line in lines[i + 1 : i + 3])
    sides = {}
    for i in range(0, 400, 2):
        if i % 10 and i % 7:
            sides.setdefault((i % 3, i % 4 == 0), []).append(i)
    want = sorted((g, f"Write for s{k}", f"text {g}", f"text {b}") for k in range(3) for g, b in zip(sides[k, True], sides[k, False], strict=False))
    assert sorted((r["row_idx"], r["instruction"], r["chosen"], r["rejected"]) for r in pairs.collect()) == want
