"""Keyed operators on streams: buffered shuffle, take and skip, mixing; each over micro-batches and restarts."""

import pytest
from corpusloom import streaming
from corpusloom.operators import mix
from corpusloom.streaming import mixing, shuffle
from pyspark.sql import functions as F

SCHEMA = "i long, text string, parts array<struct<k:int,v:string>>"


def put(spark, path, start, end):
    """One more file of rows."""
    rows = spark.range(start, end, 1, 1).select(F.col("id").alias("i"), F.concat(F.lit("t"), "id").alias("text"), F.array(F.struct(F.lit(1).alias("k"), F.lit("x").alias("v"))).alias("parts"))
    rows.write.mode("append").parquet(path)


def run(df, out, checkpoint):
    streaming.written(df, out, checkpoint).awaitTermination()


@pytest.mark.parametrize("shards", [1, 3])
def test_buffered_shuffle_over_restarts(spark, tmp_path, shards):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    stream = lambda: shuffle.shuffled(streaming.stream(spark, source, SCHEMA), "i", 40, 7, shards)
    for start, end in ((0, 25), (25, 130)):
        put(spark, source, start, end)
    run(stream(), out, checkpoint)
    half = spark.read.parquet(out).count()
    put(spark, source, 130, 200)  # a new start of the query goes on where the other ended
    run(stream(), out, checkpoint)
    left = spark.read.parquet(out)
    rest = shuffle.remaining(spark, checkpoint, spark.read.parquet(source).schema, 7)
    assert 0 < half < left.count() and rest.count() == sum(min(40, n) for n in per_shard(spark, source, shards))
    every = left.unionByName(rest).orderBy("shard", "place").collect()
    assert sorted(r["i"] for r in every) == list(range(200)) and {r["text"] for r in every} == {f"t{i}" for i in range(200)} and every[0]["parts"][0]["v"] == "x"
    owner = {r["i"]: r["shard"] for r in every}
    for s in range(shards):
        got = [r for r in every if r["shard"] == s]
        assert [r["place"] for r in got] == list(range(len(got)))
        assert [r["i"] for r in got] == list(shuffle.plain([i for i in range(200) if owner[i] == s], 40, 7, s))
    n = 30
    first = shuffle.taken(left.unionByName(rest), n, shards)
    assert first.count() == n and shuffle.skipped(left.unionByName(rest), n, shards).count() == 200 - n
    assert not {r["i"] for r in first.collect()} & {r["i"] for r in shuffle.skipped(left, n, shards).collect()}


def per_shard(spark, source, shards):
    shard = F.pmod(F.xxhash64("i"), F.lit(shards)).alias("s")
    return [r["count"] for r in spark.read.parquet(source).select(shard).groupBy("s").count().collect()]


def test_take_and_skip_on_the_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    put(spark, source, 0, 60)
    put(spark, source, 60, 100)
    for name, part in (("take", shuffle.taken), ("skip", shuffle.skipped)):
        run(part(shuffle.shuffled(streaming.stream(spark, source, SCHEMA), "i", 20), 15), str(tmp_path / name), str(tmp_path / f"{name}-ck"))
    want = list(shuffle.plain(range(100), 20))
    assert [r["i"] for r in spark.read.parquet(str(tmp_path / "take")).orderBy("place").collect()] == want[:15]
    assert [r["i"] for r in spark.read.parquet(str(tmp_path / "skip")).orderBy("place").collect()] == want[15:80]


def test_what_a_shuffle_refuses(spark):
    df = spark.range(3).withColumnRenamed("id", "place")
    for bad in (lambda: shuffle.shuffled(df, "place"), lambda: shuffle.shuffled(spark.range(3), "no"), lambda: shuffle.shuffled(spark.range(3), "id", 0), lambda: shuffle.shuffled(spark.range(3), "id", shards=0)):
        with pytest.raises(ValueError):
            bad()


CASES = [("interleave_under", None), ("interleave_over", None), ("interleave_under", [0.7, 0.3]), ("interleave_over", [0.2, 0.8])]


@pytest.mark.parametrize(("strategy", "probabilities"), CASES)
def test_mixture_of_streams_equals_that_of_tables(spark, tmp_path, strategy, probabilities):
    paths, sizes = [str(tmp_path / x) for x in "ab"], [70, 41]
    for path, n in zip(paths, sizes, strict=True):
        for start in range(0, n, 23):
            put(spark, path, start, min(n, start + 23))
    tables = [spark.read.parquet(p).withColumn("row_idx", F.col("i")) for p in paths]
    want = mix.interleaved(tables, strategy, probabilities).orderBy("mix_idx").collect()
    streams = [streaming.stream(spark, p, SCHEMA) for p in paths]
    told = sizes if strategy == "interleave_over" else None
    df = mixing.interleaved(streams, "i", strategy, probabilities, sizes=told)
    run(df, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("place").collect()
    assert [(r["place"], r["src_idx"], r["i"]) for r in got] == [(r["mix_idx"], r["src_idx"], r["row_idx"]) for r in want]


def test_a_mixture_waits_for_a_late_source_and_goes_on(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    put(spark, a, 0, 1200)  # more than a block waits
    put(spark, b, 0, 10)
    df = lambda: mixing.interleaved([streaming.stream(spark, p, SCHEMA) for p in (a, b)], "i")
    run(df(), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    put(spark, b, 10, 700)
    run(df(), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("place").collect()
    assert [(r["src_idx"], r["i"]) for r in got] == [(s, i) for i in range(700) for s in (0, 1)]


def test_shards_mix_their_own_parts(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    put(spark, a, 0, 60)
    put(spark, b, 0, 60)
    df = mixing.interleaved([streaming.stream(spark, p, SCHEMA) for p in (a, b)], "i", shards=3)
    run(df, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 120 and len({r["shard"] for r in got}) == 3
    for s in range(3):
        own = sorted((r["place"], r["src_idx"]) for r in got if r["shard"] == s)
        assert own == [(i, i % 2) for i in range(len(own))]


def test_what_a_mixture_refuses(spark):
    a = spark.range(3)
    for bad in ({"strategy": "concat"}, {"strategy": "interleave_over"}, {"probabilities": [1.0]}, {"strategy": "interleave_over", "sizes": [3, 3], "shards": 2}):
        with pytest.raises(ValueError):
            mixing.interleaved([a, a], "id", **bad)


def test_streams_are_prepared(spark, tmp_path):
    from corpusloom.config import DataArgs, DatasetSpec, RunSpec
    from corpusloom.operators import encode
    from corpusloom.operators.align import align
    from corpusloom.streaming.prepare import prepare_stream, rest

    plain = encode.Extras(tools=False)
    specs, streams, paths = {}, {}, {}
    for k, name in enumerate("ab"):
        paths[name] = str(tmp_path / name)
        for part in range(2):
            rows = spark.range(20 * part, 20 * part + 20, 1, 1).select(F.col("id").alias("row_idx"), F.lit("ask").alias("instruction"), F.concat(F.lit(f"n{k}x"), "id").alias("output"))
            rows.write.mode("append").parquet(paths[name])
        specs[name] = DatasetSpec(name, columns={"prompt": "instruction", "response": "output"})
        streams[name] = specs[name], streaming.stream(spark, paths[name], "row_idx long, instruction string, output string")
    args = DataArgs(streaming=True, max_steps=5, val_size=6, datasets=("a", "b"), mix_strategy="interleave_under")
    module = prepare_stream(RunSpec(), args, streams, buffer=10, extras=plain)
    for name, split in module.splits().items():
        run(split, str(tmp_path / f"out-{name}"), str(tmp_path / f"ck-{name}"))
    train, validation = (spark.read.parquet(str(tmp_path / f"out-{s}")) for s in ("train", "validation"))
    order = list(shuffle.plain([(i, s) for i in range(40) for s in range(2)], 10))
    assert [r["row_idx"] for r in validation.orderBy("row_idx").collect()] == list(range(6))
    assert [r["row_idx"] for r in train.orderBy("row_idx").collect()] == list(range(6, 70))
    both = validation.unionByName(train).orderBy("row_idx").collect()
    whole = align(spark.read.parquet(paths["a"]).withColumn("src_idx", F.lit(0)).unionByName(spark.read.parquet(paths["b"]).withColumn("src_idx", F.lit(1))), specs["a"])
    answers = {(r["row_idx"], r["src_idx"]): r["labels"] for r in encode.supervised(whole, "default", args, extras=plain).collect()}
    assert [r["labels"] for r in both] == [answers[x] for x in order[:70]]
    schema = align(spark.read.parquet(paths["a"]), specs["a"]).schema
    held = shuffle.remaining(spark, str(tmp_path / "ck-train"), schema)
    assert [r["labels"] for r in rest(held, RunSpec(), args, plain).orderBy("row_idx").collect()] == [answers[x] for x in order[70:]]
    for bad in ({"packing": True}, {"streaming": False, "max_steps": -1}):
        with pytest.raises(ValueError):
            prepare_stream(RunSpec(), DataArgs(**{"streaming": True, "max_steps": 5, "datasets": ("a",), **bad}), streams)
    with pytest.raises(ValueError, match="per_batch"):
        prepare_stream(RunSpec("kto"), args, streams)
