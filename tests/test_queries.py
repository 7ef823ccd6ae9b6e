"""Every query with SQL equals it on the smallest tables; streams equal batches; the entry runs."""

import glob
import math
import os

import duckdb
import pytest
from corpusloom import streaming
from corpusloom.functions.tokens import tokenizer
from corpusloom.operators import encode, pack
from corpusloom.plans import catalogue
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float):
        return float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=str)
    at = [want.columns.index(c) for c in columns]
    b = sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=str)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_packing_keeps_every_token(spark):
    from corpusloom.plans import conversations

    rows = encode.batched(encode.supervised(conversations.talk(spark, SF), "default", conversations.DataArgs(cutoff_len=512, packing=True)))
    before = rows.agg(F.sum(F.size("input_ids"))).first()[0]
    out = pack.assembled(pack.knapsack(rows, 511), 511, neat=True)
    assert out.agg(F.sum(F.size(F.filter("attention_mask", lambda x: x > 0)))).first()[0] == before
    assert out.filter(F.size("input_ids") != 512).count() == 0


def plain_bins(lengths, capacity):
    """Bins as lists of places: each takes the longest that still fits, the later one of equals, until none does."""
    left, bins = sorted(range(len(lengths)), key=lambda i: (lengths[i], i)), []
    while left:
        room, own = capacity, []
        for i in reversed(left):
            if lengths[i] <= room:
                own.append(i)
                room -= lengths[i]
        left = [i for i in left if i not in own]
        bins.append(own)
    return bins


def test_packed_queries_equal_a_plain_packing(spark):
    from corpusloom.plans import conversations

    args = conversations.DataArgs(cutoff_len=512, packing=True)
    rows = sorted(encode.batched(encode.supervised(conversations.talk(spark, SF), "default", args)).select("row_idx", "batch_id", F.size("input_ids").alias("n")).collect())
    want, packed = {}, {}
    for batch in {r["batch_id"] for r in rows}:
        own = [r for r in rows if r["batch_id"] == batch and r["n"] <= 511]
        for k, items in enumerate(plain_bins([r["n"] for r in own], 511)):
            packed[batch, k] = [own[i]["n"] for i in items]
            want |= {own[i]["row_idx"]: (batch, k, seat, own[i]["n"]) for seat, i in enumerate(items)}
    got = {r["row_idx"]: (r["batch_id"], r["bin"], r["seat"], r["n"]) for r in catalogue.queries()["pack_knapsack"](spark, SF).collect()}
    assert got == want
    for r in catalogue.queries()["packed_rows"](spark, SF).collect():
        lengths = packed.pop((r["batch_id"], r["bin"]))
        assert r["width"] == 512 and r["lengths"] == lengths and r["cu_seqlens"] == [sum(lengths[:i]) for i in range(len(lengths) + 1)] and r["last_position"] == max(lengths) - 1
    assert not packed


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    work = lambda df: df.select("doc_id", tokenizer("whitespace")(F.col("text")).alias("ids"))
    streaming.written(work(streaming.stream(spark, str(tmp_path / "in"), docs.schema)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "in"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, work(stored).collect()))


def test_batch_operators_on_a_stream(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn("row_idx", F.col("doc_id"))
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    work = lambda df: encode.chunks(encode.pretrain_ids(df, F.col("text")), 64)
    streaming.per_batch(streaming.stream(spark, str(tmp_path / "in"), docs.schema), work, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() > 0 and out.filter(F.size("input_ids") != 64).count() == 0


def test_event_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    events.write.parquet(str(tmp_path / "in"))
    q = streaming.window_counts(streaming.stream(spark, str(tmp_path / "in"), events.schema), "ts", "event_type", "value", "1 day")
    s = q.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    s.awaitTermination()
    got = spark.table("windows").select("start", "event_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
