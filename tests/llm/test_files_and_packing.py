"""WARC round trips, packing, audio, and the pipeline."""

import io
import math
import zlib
from hashlib import sha1

import numpy as np
import public_tokenizers
import pytest
from corpusloom.llm import audio, packing, warc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BIG = "<p>" + "text " * 400 + "</p>"
PAGES = [(1, "http://a", BIG), (2, None, BIG), (2, "http://b", BIG), (3, "http://c\r\nX: y", "small"), (4, "http://d", "small"), (5, "u", None), (None, "n", BIG), (6, "z", "ü" * 5000)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, payload int")
    got = sorted(map(tuple, warc.warc_records(df).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        visit = h == BIG and i != 2
        want.append((i, len(b), sha1(b).hexdigest(), "revisit" if visit else "response", 2 if visit else None))
    assert got == sorted(want, key=str)
    assert warc.warc_records(df.limit(0)).count() == 0


def test_warc_filters_reach_the_reader(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.archive(df, f"file://{tmp_path}/w")
    read = spark.read.format("warc").option("path", f"file://{tmp_path}/w").load()
    only = read.filter("record_type = 'response' and page_id in (3, 4)").select("page_id", F.decode("payload", "utf-8").alias("t"))
    assert sorted(map(tuple, only.collect())) == [(3, "small"), (4, "small")]
    reader = warc.WarcReader({"path": str(tmp_path)}, ["page_id"])
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("page_id",), 1)]))
    assert len(rest) == 1 and reader.tests == [("warc-type", frozenset({"revisit"}))]
    bare = spark.read.format("warc").option("path", f"file://{tmp_path}/w").option("payload", "false").load()
    assert bare.filter("payload is not null").count() == 0 and bare.count() == len(PAGES)


def test_warc_records_of_others():
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\nX-Long: a\r\n b\r\n\r\nabc\r\n\r\n" + warc.record_bytes(1, "u", "d", 2, b"hi", None)
    found = list(warc.read_records(io.BytesIO(raw)))
    assert [h["warc-type"] for h, _ in found] == ["warcinfo", "response"]
    assert found[0][0]["x-long"] == "a b" and found[1][1] == b"hi"
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(raw[:-8])))


def test_packing_invariants(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = np.random.default_rng(0)
    rows = [(i, " ".join(r.choice(["alpha", "beta.", "Gamma", "of", "<|endoftext|>"], int(n)))) for i, n in enumerate(r.integers(0, 3000, 120))] + [(1000, None), (1001, ""), (None, "x"), (3, "again")]
    df = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, cls int")
    out = packing.packing(df).collect()
    total = 0
    by_seq, by_doc = {}, {}
    for p in out:
        by_seq.setdefault(p["sequence_id"], []).append(p)
        by_doc.setdefault(p["doc_id"], []).append(p)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        total += len(ids)
        mine = [p for p in by_doc[i] if p["doc_tokens"] == len(ids)]
        at = 0
        for p in sorted(mine, key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert len(by_seq) <= math.ceil(total / 2048 * 1.03) + 1
    assert packing.packing(df.limit(0)).count() == 0


def test_packing_returns_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack(spark.createDataFrame([(1, "one two three")], "doc_id long, text string"), path, with_ids=True).collect()
    assert out[0]["ids"] == [*Tokenizer.from_file(path).encode("one two three", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("demand", [np.eye(128, dtype=int)[81] * 500, np.ones(128, dtype=int), np.zeros(128, dtype=int), np.random.default_rng(0).integers(0, 60, 128)])
def test_cutting_stock_covers_demand_near_its_bound(demand):
    p = packing.cutting_stock(demand)
    used = p.patterns.T @ p.times if len(p.times) else np.zeros(128)
    assert (used >= demand).all() and (p.patterns @ np.arange(1, 129) <= 128).all()
    assert p.times.sum() <= math.ceil(p.bound * 1.01) + 2


def test_a_third_of_one_length_packs_well():
    r = np.random.default_rng(1)
    sizes = [1300] * 2000 + r.integers(1, 2048, 4000).tolist()
    lengths = [n for i, size in enumerate(sizes) for n in np.diff(packing.cut(size, zlib.crc32(str(i).encode())))]
    demand = np.bincount([-(-int(n) // packing.GRAIN) for n in lengths], minlength=129)[1:]
    assert packing.cutting_stock(demand).times.sum() * 2048 <= sum(sizes) * 1.03


def tone(notes, rate=8000, note=1600):
    import wave

    phase = np.cumsum(np.repeat(2 * np.pi * 220 * 2 ** (np.array(notes) / 12) / rate, int(note * rate / 8000)))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((9000 * np.sin(phase)).astype("<i2").tobytes())
    return out.getvalue()


def test_audio_alignment(spark):
    r = np.random.default_rng(2)
    song, other = r.integers(0, 24, 60).tolist(), r.integers(0, 24, 60).tolist()
    rows = [(100, tone(song)), (1, tone(song)), (2, tone(r.integers(0, 24, 8).tolist() + song)), (3, tone(other)), (4, None), (5, b"no audio"), (6, tone([1])), (7, tone(song, rate=16000)), (None, tone(song))]
    df = spark.createDataFrame([(*x, 0) for x in rows], "id long, audio binary, votes int")
    out = {x["id"]: x for x in audio.matches(df, "id", "audio", F.col("id") % 100 == 0).collect()}
    assert out[1]["class_id"] == out[100]["class_id"] == 1 and out[1]["match_id"] is None
    assert out[2]["match_id"] == 100 and abs(out[2]["offset"] - 8 * 1600 / 512) <= 1
    assert out[7]["class_id"] == 1 or (out[7]["match_id"] == 100 and out[7]["bit_error"] <= audio.MAX_ERROR)  # another sampling rate
    assert out[3]["match_id"] is None
    assert [out[i]["n_ints"] for i in (4, 5, 6)] == [0, 0, 0]
    assert audio.matches(df.limit(0), "id", "audio", F.col("id") % 100 == 0).count() == 0


def test_alignment_equals_brute_force():
    r = np.random.default_rng(5)
    a = [r.integers(0, 50, 40).astype(np.uint32) for _ in range(6)]
    b = [np.concatenate([r.integers(0, 50, 5).astype(np.uint32), a[0]])] + [r.integers(0, 50, 40).astype(np.uint32) for _ in range(5)]
    got = {(q, f): (o, v) for q, f, o, _, v in audio.align(a, b, 1, 1.0)}
    for q in range(6):
        for f in range(6):
            votes = {}
            for i, x in enumerate(a[q]):
                for j, y in enumerate(b[f]):
                    if x == y:
                        votes[j - i] = votes.get(j - i, 0) + 1
            best = min(votes, key=lambda o: (-votes[o], o))
            overlap = min(40 - max(0, -best), len(b[f]) - max(0, best))
            assert got.get((q, f)) == ((best, votes[best]) if overlap >= 20 else None)


def test_pipeline_runs_and_each_stage_acts(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "line dedup", "simhash near-dedup", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        out = spark.createDataFrame(made.collect(), made.schema)
        if k < 4:
            assert out.columns == docs.columns
            sizes.append(out.count())
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 50
    assert {r["doc_id"] for r in docs.collect()}
