"""Arrow files by record batch, previews of data files, media looked up by a listing."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from corpusloom.config import DatasetSpec
from corpusloom.operators.align import align
from corpusloom.sources import arrow_files, catalog, preview
from corpusloom.sources.media_files import resolved
from pyspark.sql import functions as F


def arrow_table(start, n):
    names = pa.array([f"n{i % 3}" for i in range(start, start + n)]).dictionary_encode()
    return pa.table({"i": pa.array(range(start, start + n), type=pa.int64()), "t": [None if i % 7 == 0 else "ü" * (i % 5) for i in range(start, start + n)], "l": [[{"a": i}] for i in range(start, start + n)], "d": names})


def write(path, table, rows, stream=False):
    with pa.OSFile(str(path), "wb") as f, (pa.ipc.new_stream if stream else pa.ipc.new_file)(f, table.schema) as w:
        w.write_table(table, max_chunksize=rows)


def test_a_file_of_many_batches_gives_many_tasks(spark, tmp_path):
    write(tmp_path / "a.arrow", arrow_table(0, 1000), 50)
    write(tmp_path / "b.arrow", arrow_table(1000, 37), 100)
    write(tmp_path / "c.arrow", arrow_table(2000, 30), 7, stream=True)
    df = arrow_files.arrow(spark, [str(tmp_path / x) for x in ("a.arrow", "b.arrow", "c.arrow")], target=10)
    assert df.rdd.getNumPartitions() == 20 + 1 + 1
    rows = sorted(df.collect(), key=lambda r: r["i"])
    assert [r["i"] for r in rows] == [*range(1000), *range(1000, 1037), *range(2000, 2030)]
    assert all(r["t"] == (None if r["i"] % 7 == 0 else "ü" * (r["i"] % 5)) and r["l"][0]["a"] == r["i"] and r["d"] == f"n{r['i'] % 3}" for r in rows)
    assert catalog.scan(spark, str(tmp_path)).count() == 1067  # by the catalogue too
    few = arrow_files.plan(str(tmp_path / "a.arrow"), 1 << 30)
    assert [(p.first, p.end) for p in few] == [(0, 20)] and arrow_files.plan(str(tmp_path / "c.arrow"))[0].end is None


def test_only_the_footer_reaches_the_driver(tmp_path, monkeypatch):
    write(tmp_path / "big.arrow", pa.table({"x": np.random.default_rng(0).random(400_000)}), 10_000)
    before = pa.total_allocated_bytes()
    parts = arrow_files.plan(str(tmp_path / "big.arrow"), 100_000)
    assert len(parts) == 40 and arrow_files.schema_of(str(tmp_path / "big.arrow")).names == ["x"]
    assert pa.total_allocated_bytes() - before < 300_000


def test_saved_datasets_and_edges(spark, tmp_path):
    for split in ("train", "test"):
        (tmp_path / "s" / split).mkdir(parents=True)
        write(tmp_path / "s" / split / "data-0.arrow", arrow_table(0, 5), 2)
        (tmp_path / "s" / split / "state.json").write_text("{}")
    (tmp_path / "s" / "dataset_dict.json").write_text("{}")
    got = arrow_files.saved_dataset(spark, str(tmp_path / "s"))
    assert {(r["split"], r["count"]) for r in got.groupBy("split").count().collect()} == {("train", 5), ("test", 5)}
    assert arrow_files.saved_dataset(spark, str(tmp_path / "s" / "test")).count() == 5
    write(tmp_path / "none.arrow", arrow_table(0, 0), 5)
    assert arrow_files.arrow(spark, [str(tmp_path / "none.arrow")]).count() == 0
    write(tmp_path / "other.arrow", pa.table({"i": pa.array([7], type=pa.int32())}), 1)
    both = arrow_files.arrow(spark, [str(tmp_path / "s" / "test" / "data-0.arrow"), str(tmp_path / "other.arrow")])
    assert sorted((r["i"], r["t"]) for r in both.collect() if r["i"] == 7) == [(7, None)]


TRICKY = [[], {}, "a,b", 'quote " and \\ slash', "[{", ["nested", ["deeper", {"k": [1, 2, {"z": "],["}]}]], 1.5, None, True, {"é,": "ü\n\\\\"}, "\\", "", {"a": {"b": {"c": []}}}]


@pytest.mark.parametrize("block", [1, 3, 7, 64, 1 << 20])
@pytest.mark.parametrize("style", [{"indent": 1}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_pages_of_a_json_array(spark, tmp_path, block, style):
    r = random.Random(block)
    rows = TRICKY + ([r.choice(TRICKY) for _ in range(20)] if block > 1 else [])
    path = str(tmp_path / "x.json")
    (tmp_path / "x.json").write_text("\n " + json.dumps(rows, **style) + " \n", encoding="utf-8")
    if block == 1:  # a block a byte, without a task each
        data = (tmp_path / "x.json").read_bytes()
        state, depth, commas = 0, 0, 0
        for b in data:
            s = preview.summary(bytes([b]), state)
            commas += s.commas.get(1 - depth, 0)
            state, depth = s.state, depth + s.depth
        assert (state, depth, commas + 1) == (0, 0, len(rows))
        return
    found = preview.array(spark, path, block)
    assert found.count == len(rows)
    for start, end in ((0, 2), (1, 5), (len(rows) - 1, len(rows) + 3), (0, len(rows)), (len(rows), len(rows) + 2), (4, 4)):
        assert preview.elements(found, start, end) == rows[start:end]


def test_previews(spark, tmp_path):
    (tmp_path / "a.json").write_text("[1, {\"a\": 2}, 3]")
    (tmp_path / "b.jsonl").write_text("4\n5\n")
    (tmp_path / "c.txt").write_text("six\nseven\n")
    assert preview.preview(spark, str(tmp_path / "a.json"), 1) == (3, [3])
    assert preview.preview(spark, str(tmp_path / "b.jsonl")) == (2, [4, 5]) and preview.preview(spark, str(tmp_path / "c.txt"), 5) == (2, [])
    whole = [1, {"a": 2}, 3, 4, 5, "six", "seven"]
    for page in range(5):
        assert preview.preview(spark, str(tmp_path), page) == (7, whole[2 * page : 2 * page + 2])
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "e.json").write_text(" [ ] ")
    assert preview.preview(spark, str(tmp_path / "d" / "e.json")) == (0, [])
    for bad in ('{"a": 1}', "[1, 2", '["a]'):
        (tmp_path / "d" / "e.json").write_text(bad)
        with pytest.raises(ValueError):
            preview.preview(spark, str(tmp_path / "d" / "e.json"))
    assert [preview.turned(p, 5, s) for p, s in ((0, -1), (1, -1), (0, 1), (2, 1))] == [0, 0, 1, 2]


def test_media_that_exist_get_their_folder(spark, tmp_path):
    for name in ("a.png", "sub/b.png", "c d.wav"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    root = str(tmp_path)
    rows = [(0, ["z.png", "a.png", "sub/b.png", "a.png"], "c d.wav"), (1, [], None), (2, None, "none.wav"), (3, [f"{root}/a.png", "http://x/a.png", "b.png", None], "c d.wav")]
    rows += [(10 + i, ["a.png"], None) for i in range(500)]  # a path of most rows
    df = spark.createDataFrame(rows, "row_idx long, images array<string>, sound string").withColumns({"instruction": F.lit("<image>"), "output": F.lit("x")})
    spec = DatasetSpec("m", columns={"prompt": "instruction", "response": "output", "images": "images", "audios": "sound"})
    got = {r["row_idx"]: r for r in align(df, spec, root).collect()}
    assert len(got) == 504 and got[0]["_images"] == ["z.png", f"{root}/a.png", f"{root}/sub/b.png", f"{root}/a.png"] and got[0]["_audios"] == [f"{root}/c d.wav"]
    assert got[1]["_images"] is None and got[1]["_audios"] is None and got[2]["_audios"] == ["none.wav"]
    assert got[3]["_images"] == [f"{root}/a.png", "http://x/a.png", "b.png", None] and all(got[10 + i]["_images"] == [f"{root}/a.png"] for i in range(500))
    assert align(df, DatasetSpec("m", source="hub", columns=spec.columns), root).filter("row_idx = 10").first()["_images"] == ["a.png"]
    assert resolved(df.drop("row_idx"), ["images"], f"{root}/no such folder").count() == 504
    assert resolved(df.drop("row_idx"), ["images"], root).filter(F.array_contains("images", f"{root}/a.png")).count() == 502
