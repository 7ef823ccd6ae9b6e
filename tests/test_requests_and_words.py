"""Chat requests, word segmentation, sound inside of videos."""

import itertools
import json
import random
from math import log

import pytest
from corpusloom.functions import media, segment
from corpusloom.operators import evaluate, requests
from pyspark.sql import functions as F


def answer(spark, *bodies):
    rows = spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b, ensure_ascii=False)) for i, b in enumerate(bodies)], "i int, request string")
    return requests.converted(rows).orderBy("i").collect()


def user(text):
    return {"role": "user", "content": text}


def test_requests_become_rows(spark):
    call = {"role": "assistant", "content": None, "tool_calls": [{"id": "1", "function": {"name": "price", "arguments": '{"k": "é\\"x"}'}}, {"function": {"name": "b", "arguments": "{}"}}]}
    parts = {"role": "user", "content": [{"type": "text", "text": "see "}, {"type": "image_url", "image_url": {"url": "http://a/1.png"}}, {"type": "audio_url", "audio_url": {"url": "s.wav"}}, {"type": "text", "text": " and "}, {"type": "image_url", "image_url": {"url": "2.png"}}, {"type": "video_url", "video_url": {"url": "v"}}]}
    tools = [{"type": "function", "function": {"name": "price", "parameters": {"b": 1, "a": [2]}}}]
    a, b, c = answer(
        spark, {"messages": [{"role": "system", "content": "be brief"}, user("ask"), call, {"role": "tool", "content": "[1]"}], "tools": tools},
        {"messages": [parts]}, {"messages": [user("1"), {"role": "function", "content": "f"}, user("[not a list]")], "tools": []},
    )
    assert a["error"] is None and a["_system"] == "be brief" and a["_images"] is None
    assert [(m["role"], m["content"]) for m in a["_prompt"]][::2] == [("user", "ask"), ("observation", "[1]")]
    made = a["_prompt"][1]
    assert made["role"] == "function" and json.loads(made["content"]) == [{"name": "price", "arguments": '{"k": "é\\"x"}'}, {"name": "b", "arguments": "{}"}]
    assert made["content"] == json.dumps(json.loads(made["content"]), ensure_ascii=False)
    assert json.loads(a["_tools"]) == [t["function"] for t in tools]
    assert b["_prompt"][0]["content"] == "see <image><audio> and <image><video>"
    assert (b["_images"], b["_videos"], b["_audios"], b["_system"], b["_tools"]) == (["http://a/1.png", "2.png"], ["v"], ["s.wav"], None, None)
    assert [m["role"] for m in c["_prompt"]] == ["user", "function", "user"] and c["_prompt"][2]["content"] == "[not a list]" and c["_tools"] is None


WRONG = [
    ({"messages": []}, "no messages"), ({"messages": [user("a"), user("b")]}, "alternate"), ({"messages": [{"role": "system", "content": "s"}]}, "alternate"),
    ({"messages": [{"role": "assistant", "content": "a"}]}, "role"), ({"messages": [user("a"), user("b"), user("c")]}, "role"), ({"messages": [user("a"), {"role": "assistant", "content": "x"}, {"role": "system", "content": "s"}]}, "role"),
    ({"messages": [{"role": "poet", "content": "a"}]}, "role"), ({"messages": [{"role": "user", "content": [{"type": "file", "text": "x"}]}]}, "kind of part: file"), ("{broken", "cannot be read"), ({"tools": []}, "cannot be read"), ("", "cannot be read"),
]


def test_what_is_wrong_with_a_request(spark):
    for row, (_, text) in zip(answer(spark, *(w for w, _ in WRONG)), WRONG, strict=True):
        assert text in row["error"] and row["_prompt"] is None and row["_images"] is None
    null = requests.converted(spark.createDataFrame([(None,)], "request string")).first()
    assert null["error"] == "the request cannot be read"


def brute_words(block, words):
    """The heaviest of all ways to cut a block; of equal ones that with the longest first word, and so on."""
    total = sum(words.values())
    weight = lambda w: log(words[w]) - log(total) if w in words else (-log(total) if len(w) == 1 else None)
    best = None
    for n in range(len(block)):
        for cuts in itertools.combinations(range(1, len(block)), n):
            parts = [block[a:b] for a, b in zip((0, *cuts), (*cuts, len(block)), strict=True)]
            weights = [weight(p) for p in parts]
            if None in weights:
                continue
            total_weight = 0.0
            for w in reversed(weights):
                total_weight += w
            key = (round(total_weight, 9), [len(p) for p in parts])
            if best is None or key > best[0]:
                best = key, parts
    return best[1]


WORDS = {"我们": 90, "在": 200, "这里": 60, "学习": 40, "中文": 30, "中": 50, "文": 10, "学": 20, "习": 5, "分词": 15, "中文分词": 3, "研究": 30, "研究生": 25, "生命": 30, "起源": 20, "命": 8, "的": 300, "生": 30}


def test_segmentation_is_the_likeliest_path():
    s = segment.Segmenter(WORDS)
    assert s.cut("我们在这里学习中文分词") == ["我们", "在", "这里", "学习", "中文", "分词"] or s.cut("我们在这里学习中文分词") == brute_words("我们在这里学习中文分词", WORDS)
    r = random.Random(4)
    letters = sorted({c for w in WORDS for c in w}) + ["龙"]
    for _ in range(150):
        block = "".join(r.choice([r.choice(letters), r.choice(list(WORDS))]) for _ in range(r.randint(1, 6)))[:9]
        assert s.path(block) == brute_words(block, WORDS), block
    assert s.cut("用GPU2 学习, ok\n我们") == ["用", "GPU2", " ", "学习", ",", " ", "ok", "\n", "我们"]
    assert s.cut("") == [] and "".join(s.cut("任意 text！")) == "任意 text！"
    with pytest.raises(ValueError):
        segment.Segmenter({"": 1})


def test_rouge_over_segmented_words(spark, tmp_path):
    (tmp_path / "d.txt").write_text("\n".join(f"{w} {n} x" for w, n in WORDS.items()) + "\n\nbroken\n")
    s = segment.dictionary(spark, str(tmp_path / "d.txt"))
    rows = [("研究生命的起源", "我们研究生命起源"), ("我们在这里", "我们在这里学习"), ("", "中文"), ("在 我们", "我们在")]
    got = evaluate.overlap_scores(spark.createDataFrame(rows, "predict string, label string"), segment=s).collect()
    for row, (a, b) in zip(got, rows, strict=True):
        cut = [" ".join(w for part in x.split() for w in brute_words(part, WORDS)) for x in (a, b)]
        assert (row["rouge_1"], row["rouge_2"], row["rouge_l"]) == evaluate.rouge(*cut)
    assert got[1]["rouge_1"] != evaluate.rouge(*rows[1])[0]


def by_tokens(times, per_chunk=50):
    """Sizes of chunks, a token at a time: a token at or behind the chunk's end opens the next."""
    sizes, chunk = [0], 1
    for t in times:
        if t >= chunk * per_chunk:
            sizes.append(0)
            chunk += 1
        sizes[-1] += 1
    return sizes


def test_time_chunks_by_token(spark):
    cases = [(t, n, s) for t in (0, 1, 2, 5, 9, 40) for n in (1, 3, 6) for s in (0.5, 1.0, 1.7, 2.0, 4.0, 9.5)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t int, n int, s double")
    for r in df.select("*", media.time_chunks(F.col("t"), F.col("n"), F.col("s")).alias("c")).collect():
        assert r["c"] == by_tokens([int(i * r["s"] * 25) for i in range(r["t"]) for _ in range(r["n"])]), r
    for r in spark.range(0, 160).select("id", media.sound_chunks(F.col("id").cast("int")).alias("c")).collect():
        assert r["c"] == by_tokens(range(r["id"]))


def test_videos_with_sound(spark):
    def made(text, videos, sounds):
        df = spark.createDataFrame([([("user", text), ("assistant", "fine <audio>"[:4])], videos, sounds)], "m array<struct<role:string,content:string>>, v array<struct<t:int,h:int,w:int,seconds:double>>, s array<int>")
        return df.select(media.videos_with_sound(F.col("m"), F.col("v"), F.col("s")).alias("o")).first()["o"][0]["content"]

    # three frames of one token, a second apart: 0 and 25 in the first chunk, 50 in the second; 60 places of sound: 50 and 10
    assert made("a <video><audio> b", [(3, 2, 2, 1.0)], [60]) == "a <|vision_bos|><|audio_bos|>" + "<|VIDEO|>" * 2 + "<|AUDIO|>" * 50 + "<|VIDEO|>" + "<|AUDIO|>" * 10 + "<|audio_eos|><|vision_eos|> b"
    # the sound is longer than the video, and the second video has none left of its own
    two = made("<audio><video> <video><audio>", [(1, 2, 2, 1.0), (1, 2, 4, 1.0)], [120, 1])
    assert two == "<|vision_bos|><|audio_bos|><|VIDEO|>" + "<|AUDIO|>" * 120 + "<|audio_eos|><|vision_eos|> <|vision_bos|><|audio_bos|><|VIDEO|><|VIDEO|><|AUDIO|><|audio_eos|><|vision_eos|>"
    assert made("no media", [], []) == "no media"
    for bad in (("<video>", [], []), ("<video>", [(1, 2, 2, 1.0)], []), ("none", [(1, 2, 2, 1.0)], [3])):
        with pytest.raises(Exception, match="each video"):
            made(*bad)
