"""Log lines: appended once, followed by byte offset, over failures and restarts."""

import json

import pytest
from corpusloom import streaming
from corpusloom.streaming import logs
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F


def follow(spark, source, out, checkpoint):
    """Runs a tail through what is there."""
    q = logs.tail(spark, source, ".jsonl").writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r["file"].rpartition("/")[2], r["offset"], r["value"]) for r in spark.read.parquet(out).collect())


def test_a_growing_file_is_read_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "SPLIT", 50)  # many parts
    source, out, checkpoint = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "ck")
    source.mkdir()
    a, b = source / "a.jsonl", source / "b.jsonl"
    rows = [json.dumps({"step": i, "text": "ü" * (i % 7)}) for i in range(200)]
    text = "".join(r + "\n" for r in rows).encode()
    a.write_bytes(text[:1501])  # ends within a line
    (source / "skip.txt").write_text("not this\n")
    assert len(follow(spark, str(source), out, checkpoint)) == text[:1501].count(b"\n")
    with a.open("ab") as f:
        f.write(text[1501:1503])
    follow(spark, str(source), out, checkpoint)
    with a.open("ab") as f:
        f.write(text[1503:] + b"half")
    b.write_bytes(b"one\r\n\ntwo\n")
    got = follow(spark, str(source), out, checkpoint)
    assert [v for n, _, v in got if n == "a.jsonl"] == rows
    assert [(o, v) for n, o, v in got if n == "b.jsonl"] == [(0, "one"), (5, ""), (6, "two")]
    assert all(text[o : o + len(v.encode())] == v.encode() for n, o, v in got if n == "a.jsonl")
    with a.open("ab") as f:
        f.write(b" line\n")
    assert follow(spark, f"file://{source}", out, checkpoint)[200][2] == "half line"


def test_ends_of_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "STEP", 3)
    p = tmp_path / "x"
    p.write_bytes(b"ab\n" + b"c" * 20 + b"\nrest of it")
    with p.open("rb") as f:
        assert logs.last_line_end(f, 0, 34) == 24 and logs.last_line_end(f, 3, 20) == 3 and logs.last_line_end(f, 0, 2) == 0
        assert logs.next_line(f, 0, 34) == 3 and logs.next_line(f, 3, 34) == 24 and logs.next_line(f, 24, 34) == 34


def test_a_killed_query_appends_each_line_once(spark, tmp_path):
    source, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "ck")
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).select(F.col("id").alias("step")).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: streaming.stream(spark, source, "step long").select(F.to_json(F.struct("step")).alias("value"))
    # the second batch dies after it has been written and before it is committed
    died = []

    def write_and_die(batch, number):
        batch.write.mode("overwrite").text(f"{path}/batch={number:012d}")
        if number == 1:
            died.append(number)
            raise RuntimeError("killed")

    q = stream().writeStream.foreachBatch(write_and_die).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(StreamingQueryException):
        q.awaitTermination()
    assert died and logs.lines(spark, path).count() == 20
    logs.append(stream(), path, checkpoint).awaitTermination()
    steps = [(r["batch"], json.loads(r["line"])["step"]) for r in logs.lines(spark, path).collect()]
    assert sorted(s for _, s in steps) == list(range(30)) and {b for b, _ in steps} == {0, 1, 2}
    (tmp_path / "log" / "batch=000000000003").mkdir()  # begun, and not marked
    (tmp_path / "log" / "batch=000000000003" / "part-0.txt").write_text("half\n")
    assert logs.lines(spark, path).count() == 30


def test_records_and_an_empty_log(spark, tmp_path):
    assert logs.lines(spark, str(tmp_path / "none")).count() == 0
    spark.range(3).select("id", F.lit("ü").alias("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    logs.append_records(streaming.stream(spark, str(tmp_path / "in"), "id long, t string"), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["line"] for r in logs.lines(spark, str(tmp_path / "log")).collect()) == [f'{{"id":{i},"t":"ü"}}' for i in range(3)]
