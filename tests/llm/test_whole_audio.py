"""All alignments of recordings against brute force over pairs."""

import numpy as np
from corpusloom.llm import audio
from pyspark.sql import functions as F

from tests.llm.test_files_and_packing import tone


def test_every_aligned_pair_is_returned(spark):
    r = np.random.default_rng(3)
    song = r.integers(0, 24, 60).tolist()
    lead = [r.integers(0, 24, k).tolist() for k in (3, 6, 9)]
    rows = [(100, tone(song)), (200, tone(lead[0] + song)), (300, tone(lead[1] + song)), (1, tone(lead[2] + song)), (2, tone(lead[2] + song)), (3, tone(r.integers(0, 24, 60).tolist())), (4, None)]
    df = spark.createDataFrame(rows, "id long, audio binary")
    out = audio.all_matches(df, "id", "audio", F.col("id") % 100 == 0).collect()
    prints = {i: audio.fingerprint(a) for i, a in rows}
    want = {(i, q) for i in (100, 200, 300, 1, 3) for q in (100, 200, 300) if i != q and audio.align([prints[q]], [prints[i]])}
    assert {(1, 100), (1, 200), (1, 300)} <= want
    assert {(x["id"], x["match_id"]) for x in out if x["match_id"] is not None} == want
    assert sum(x["match_id"] is not None for x in out) == len(want)
    assert {x["id"]: x["class_id"] for x in out} == {100: 100, 200: 200, 300: 300, 1: 1, 2: 1, 3: 3, 4: 4}
    best = {x["id"]: x for x in audio.matches(df, "id", "audio", F.col("id") % 100 == 0).collect()}
    assert best[2]["match_id"] == best[1]["match_id"] and len(best) == 7


def test_the_best_passing_offset_counts():
    """The most voted offset overlaps too little or errs too much; a less voted one passes."""
    r = np.random.default_rng(9)
    loop = np.full(12, 7, dtype=np.uint32)
    body = r.integers(0, 2**32, 30, dtype=np.uint32)
    a = np.concatenate([loop, body])
    b = np.concatenate([body, loop])
    a2 = np.concatenate([body[:5], loop, body[5:], loop])
    for q, f in ((a, b), (b, a), (a, a2), (a2, b)):
        fine = {}
        for o in range(-len(q) + 1, len(f)):
            x, y = q[max(0, -o) :], f[max(0, o) :]
            n = min(len(x), len(y))
            if (x[:n] == y[:n]).sum() >= 4 and n >= 0.5 * min(len(q), len(f)):
                error = float(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n)
                if error <= audio.MAX_ERROR:
                    fine[o] = error
        got = audio.align([q], [f], every=True)
        assert [x[3] for x in got] == ([min(fine.values())] if fine else [])
        assert not got or got[0][2] in fine
    body = r.integers(0, 2**32, 60, dtype=np.uint32)
    flipped = body ^ np.where(np.arange(60) % 2, 1, 0).astype(np.uint32)
    looped = [np.concatenate([np.full(50, 3, np.uint32), body]), np.concatenate([flipped, np.full(50, 3, np.uint32)])]
    assert audio.align(looped[:1], looped[1:]) == []
    assert [x[2] for x in audio.align(looped[:1], looped[1:], every=True)] == [-50]


def test_the_query_finds_copies_and_nothing_else(spark):
    """Copies lack notes at their start and have noise; the direct comparison of all pairs at all offsets is the measure."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    found = {(r["vec_id"], r["match_id"]): r for r in audio.media_fingerprints(vectors).collect() if r["match_id"] is not None}
    prints = {r["vec_id"]: audio.fingerprint(audio.played(r["audio"].asDict())) for r in audio.recordings(vectors).collect()}
    copies = {(i, i - i % 100) for i in prints if i % 10 == audio.COPY}
    assert len(copies) == 50

    def least_error(a, b):
        errors = []
        for o in range(-len(a) + 1, len(b)):
            x, y = a[max(0, -o) :], b[max(0, o) :]
            n = min(len(x), len(y))
            if n >= audio.MIN_OVERLAP * min(len(a), len(b)):
                errors.append(float(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n))
        return min(errors)

    near = {(i, q) for q in range(0, 500, 100) for i in prints if i != q and least_error(prints[q], prints[i]) <= 0.15}
    assert near == copies
    assert len(set(found) & near) >= 0.9 * len(near)
    assert set(found) <= near
    for (i, _), r in found.items():
        assert r["offset"] < 0 and r["bit_error"] <= audio.MAX_ERROR and r["votes"] >= audio.MIN_VOTES


def test_recordings_of_any_rows(spark):
    rows = [(100, [0.1] * 40), (107, None), (117, [0.2] * 40), (207, [0.3] * 40), (None, [0.1] * 40), (5, None), (100, [0.4] * 40), (300, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, base string").select("vec_id", "embedding")
    got = sorted(((r["vec_id"], r["audio"]["drop"]) for r in audio.recordings(df).collect()), key=str)
    assert len(got) == 8 and (107, 11) in got and (117, 12) in got and (207, 0) in got
    assert audio.media_fingerprints(df).count() >= 8 and audio.media_fingerprints(df.limit(0)).count() == 0
