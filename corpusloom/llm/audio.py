"""Chroma fingerprints of a column of audio, and the alignment of recordings by them.

Fingerprint: the signal becomes frames of energy per pitch class; an integral image over these frames lets 16 box filters be
evaluated in constant time; each filter is quantised to two bits (Gray code), so each frame gives one packed 32-bit integer.
Alignment: equal integers of two recordings vote for an offset; at each offset with enough votes the bit errors of the overlap
are counted, and the smallest counts. A stated set of queries is compared with all recordings, block by block.

Defined cases: null, empty or unreadable audio, and audio shorter than the filters reach, has no integers and matches nothing;
recordings with equal integers form one class, and only its smallest id is compared (copies are never paired); every aligned
pair of classes is returned; for the best match ties go to the smaller error, then more votes, then the smaller query id; very long audio is read in blocks; an empty table gives an empty
result. Rows with a null id are fingerprinted but not compared. Only id and audio are read.
"""

from __future__ import annotations

import io
import wave
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored

RATE, FRAME, HOP = 8000, 2048, 512
LOWEST, HIGHEST = 100.0, 2000.0
#: Width of the widest filter in frames, and the quantisation step (in log energy).
REACH, STEP = 16, 0.05
MIN_VOTES, MAX_ERROR, MIN_OVERLAP = 4, 0.30, 0.5
BLOCK = 256


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, classes, frames): kinds and places by rule, in turn."""
    return [(k % 4, (5 * k) % 12 % (13 - (2 + k % 5)), 2 + k % 5, (4, 8, 12, 16)[k // 4]) for k in range(16)]


def _pitch_classes() -> tuple[np.ndarray, np.ndarray]:
    """Frequency bins in order of their pitch class, and where each of the 12 classes starts."""
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero((freq >= LOWEST) & (freq <= HIGHEST))
    classes = np.round(12 * np.log2(freq[used] / 440.0)).astype(int) % 12
    order = np.argsort(classes, kind="stable")
    return used[order], np.searchsorted(classes[order], np.arange(12))


_BINS, _STARTS = _pitch_classes()
_WINDOW = np.hanning(FRAME)


def samples(audio: bytes | None) -> np.ndarray:
    """Mono samples at ``RATE``; empty if the bytes are no PCM WAV."""
    if not audio:
        return np.zeros(0)
    try:
        with wave.open(io.BytesIO(audio)) as w:
            width, channels, rate, data = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0)
    if width not in (1, 2, 4):
        return np.zeros(0)
    raw = np.frombuffer(data[: len(data) // (width * channels) * width * channels], dtype={1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    mono = ((raw - 128) / 128 if width == 1 else raw / 2.0 ** (8 * width - 1)).reshape(-1, channels).mean(axis=1)
    if rate != RATE and len(mono):
        mono = np.interp(np.arange(int(len(mono) * RATE / rate)) * rate / RATE, np.arange(len(mono)), mono)
    return mono


def chroma(signal: np.ndarray) -> np.ndarray:
    """(frames, 12) of pitch-class energy, each frame of length 1 (0 where silent)."""
    n = (len(signal) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    out = np.empty((n, 12))
    view = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    for at in range(0, n, 1024):
        spectrum = np.fft.rfft(view[at : at + 1024] * _WINDOW)[:, _BINS]
        out[at : at + 1024] = np.add.reduceat(spectrum.real**2 + spectrum.imag**2, _STARTS, axis=1)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-12), 0.0)


def fingerprint(audio: bytes | None) -> np.ndarray:
    """Packed integers (unsigned 32-bit), one per frame that the widest filter fits after."""
    c = chroma(samples(audio))
    n = len(c) - REACH + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint32)
    integral = np.zeros((len(c) + 1, 13))
    integral[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return integral[at + t1, p1] - integral[at + t0, p1] - integral[at + t1, p0] + integral[at + t0, p0]

    packed = np.zeros(n, dtype=np.uint32)
    for kind, p, height, width in filters():
        t, h = width // 2, height // 2
        if kind == 0:  # the box against the rest of its frames
            a, b = box(0, width, p, p + height), box(0, width, 0, 12) - box(0, width, p, p + height)
        elif kind == 1:  # first half of the time against the second
            a, b = box(0, t, p, p + height), box(t, width, p, p + height)
        elif kind == 2:  # low half of the classes against the high
            a, b = box(0, width, p, p + h), box(0, width, p + h, p + height)
        else:  # diagonal quarters against each other
            a, b = box(0, t, p, p + h) + box(t, width, p + h, p + height), box(t, width, p, p + h) + box(0, t, p + h, p + height)
        value = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))
        level = (value >= -STEP).astype(np.uint32) + (value >= 0) + (value >= STEP)
        packed = packed << np.uint32(2) | (level ^ level >> np.uint32(1))
    return packed


def align(query: list[np.ndarray], found: list[np.ndarray], min_votes: int = MIN_VOTES, max_error: float = MAX_ERROR, every: bool = False) -> list[tuple[int, int, int, float, int]]:
    """(query, recording, offset, error, votes) of the pairs of two blocks that align; offset: place in the recording less in the query.

    A pair is tested at its most voted offset, or with ``every`` at all offsets of ``min_votes`` or more: the smallest error counts.
    """
    q_all, r_all = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (query, found))
    q_own, r_own = (np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (query, found))
    q_at, r_at = (np.concatenate([np.arange(len(v)) for v in x]) if x else np.zeros(0, int) for x in (query, found))
    order = np.argsort(q_all, kind="stable")
    q_sorted = q_all[order]
    out = []
    lo, hi = np.searchsorted(q_sorted, r_all, "left"), np.searchsorted(q_sorted, r_all, "right")
    starts = np.searchsorted(r_own, np.arange(len(found) + 1))
    for r in range(len(found)):
        s, e = starts[r], starts[r + 1]
        n = hi[s:e] - lo[s:e]
        if not n.sum():
            continue
        j = np.repeat(np.arange(s, e), n)
        i = order[np.repeat(lo[s:e], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        shift = r_at[j] - q_at[i]
        keys, votes = np.unique(q_own[i] * (1 << 32) + (shift + (1 << 31)), return_counts=True)
        owner = keys >> 32
        best = np.lexsort((keys, -votes, owner))
        tried = best if every else best[np.unique(owner[best], return_index=True)[1]]
        least: dict[int, tuple[int, int, int, float, int]] = {}
        for f in tried[votes[tried] >= min_votes]:
            q, offset = int(owner[f]), int((keys[f] & 0xFFFFFFFF) - (1 << 31))
            a, b = query[q], found[r]
            a0, b0 = max(0, -offset), max(0, offset)
            overlap = min(len(a) - a0, len(b) - b0)
            if overlap < MIN_OVERLAP * min(len(a), len(b)):
                continue
            error = float(np.bitwise_count(a[a0 : a0 + overlap] ^ b[b0 : b0 + overlap]).sum()) / (32 * overlap)
            if error <= max_error and (q not in least or error < least[q][3]):
                least[q] = q, r, offset, error, int(votes[f])
        out += least.values()
    return out


def fingerprints(rows: DataFrame, id_col: str, audio_col: str, reader=None) -> DataFrame:
    """id, ints (packed binary, little-endian unsigned 32-bit), digest of every row; ``reader`` makes WAV bytes of other values."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sounds = map(reader, part.column(1).to_pylist()) if reader else part.column(1).to_pylist()
                packed = [fingerprint(x).astype("<u4").tobytes() for x in sounds]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, type=pa.binary()), pa.array([sha1(x).hexdigest() for x in packed])], names=["id", "ints", "digest"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio")).mapInArrow(run, f"id {kind}, ints binary, digest string")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (ids, ints) of up to ``size`` recordings each, built inside partitions."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, ints = (pa.array([x.to_pylist()]) for x in part.columns)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.list_(part.schema.types[0])), ints.cast(pa.list_(pa.binary()))], names=["ids", "ints"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "ints").mapInArrow(run, f"ids array<{kind}>, ints array<binary>")


def _compared(rows: DataFrame, id_col: str, audio_col: str, is_query, block: int, reader) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of all rows, their classes, and every aligned (class, query of another class): id, match_id, offset, bit_error, votes."""
    prints = stored(fingerprints(rows, id_col, audio_col, reader), "audio")
    classes = stored(prints.filter("length(ints) > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.min(F.when(is_query, F.col("id"))).alias("query"), F.first("ints").alias("ints")), "classes")
    kind = dict(prints.dtypes)["id"]
    every = _blocks(classes, block)
    asked = _blocks(classes.filter("query is not null").select(F.col("query").alias("id"), "ints"), block)
    pairs = every.crossJoin(asked.select(F.col("ids").alias("q_ids"), F.col("ints").alias("q_ints")))  # blocks of a stated query set

    def compare(batches):
        unpack = lambda column: [np.frombuffer(x, dtype="<u4") for x in column]
        for batch in batches:
            for ids, ints, q_ids, q_ints in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [x for x in align(unpack(q_ints), unpack(ints), every=True) if q_ints[x[0]] != ints[x[1]]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[x[1]] for x in found], type=batch.schema.types[0].value_type), pa.array([q_ids[x[0]] for x in found], type=batch.schema.types[0].value_type),
                        pa.array([x[2] for x in found], type=pa.int64()), pa.array([x[3] for x in found], type=pa.float64()), pa.array([x[4] for x in found], type=pa.int64()),
                    ],
                    names=["id", "match_id", "offset", "bit_error", "votes"],
                )

    scored = pairs.select("ids", "ints", "q_ids", "q_ints").mapInArrow(compare, f"id {kind}, match_id {kind}, offset long, bit_error double, votes long")
    return prints, classes, scored


def _named(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """id, n_ints, class_id of every row, and digest."""
    own = prints.withColumn("n_ints", (F.length("ints") / 4).cast("long")).drop("ints")
    named = own.join(classes.select("digest", F.col("id").alias("class_id")), "digest", "left")
    return named.select("id", "n_ints", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"), "digest")


def matches(rows: DataFrame, id_col: str, audio_col: str, is_query, block: int = BLOCK, reader=None) -> DataFrame:
    """A row per recording: id, n_ints, class_id, and its best match among the queries of other classes: match_id, offset, bit_error, votes.

    ``is_query`` is a condition on the column id. Queries are a stated set, compared with all classes in blocks.
    """
    prints, classes, scored = _compared(rows, id_col, audio_col, is_query, block, reader)
    best = scored.groupBy("id").agg(F.min(F.struct("bit_error", (-F.col("votes")).alias("v"), "match_id", "offset")).alias("m"))
    by_class = classes.select("digest", "id").join(best, "id").select("digest", "m")
    return _named(prints, classes).join(by_class, "digest", "left").select(
        "id", "n_ints", "class_id", F.col("m.match_id").alias("match_id"), F.col("m.offset").alias("offset"), F.col("m.bit_error").alias("bit_error"), (-F.col("m.v")).alias("votes"),
    )


def all_matches(rows: DataFrame, id_col: str, audio_col: str, is_query, block: int = BLOCK, reader=None) -> DataFrame:
    """Every aligned pair of classes: the columns of ``matches``, a row per recording and further rows for further matches.

    What holds for a class stands at the recording that names it (id = class_id): a row per query class that it aligns with, one
    row without a match if there is none. Its other members have one row each, without a match, and share the matches by class_id.
    """
    prints, classes, scored = _compared(rows, id_col, audio_col, is_query, block, reader)
    named = _named(prints, classes).drop("digest")
    found = scored.withColumnRenamed("id", "class_id")
    at = (named["id"] == found["class_id"]) & (named["class_id"] == found["class_id"])
    return named.join(found, at, "left").select(named["id"], "n_ints", named["class_id"], "match_id", "offset", "bit_error", "votes")


def tune(vector: list[float] | None, note: int = 1000, drop: int = 0, noise: float = 0.0, seed: int = 0) -> bytes | None:
    """A vector as a WAV melody, one note a coefficient; for tables without audio. A copy can lack its first notes and have noise on it."""
    if vector is None:
        return None
    v = np.clip(np.array([0.0 if x is None else x for x in vector[drop:]], dtype=float), -0.5, 0.5)
    steps = np.floor((v + 0.5) * 24)
    phase = np.cumsum(np.repeat(2 * np.pi * 220 * 2 ** (steps / 12) / RATE, note))
    wave_form = np.sin(phase) + 0.3 * np.sin(2 * phase)
    if noise:
        wave_form = wave_form + noise * np.random.default_rng(seed).standard_normal(len(wave_form))
    sound = np.clip(12000 * wave_form, -32768, 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes(sound.tobytes())
    return out.getvalue()


#: Of a hundred ids, those that end in this digit are copies; they lack up to so many notes, and have so much noise for a full note's swing of 1.
COPY, DROPPED, NOISE = 7, 16, 0.02


def recordings(vectors: DataFrame) -> DataFrame:
    """vec_id and audio (struct<vector, drop, seed>) of every row of ``embeddings``: its own melody, or that of another recording, played again.

    A row whose id ends in ``COPY`` plays the melody of the row that leads its hundred, without its first notes and with noise. Its
    own melody stays where that row is not there or has no vector.
    """
    leads = vectors.filter(F.col("vec_id") % 100 == 0).groupBy((F.col("vec_id").cast("long")).alias("lead")).agg(F.first("embedding").alias("led"))
    copy = F.col("vec_id") % 10 == COPY
    base = F.when(copy, F.col("vec_id") - F.pmod("vec_id", F.lit(100))).cast("long")
    both = vectors.withColumn("base", base).join(leads, F.col("base") == F.col("lead"), "left")
    drop = F.when(copy & F.col("led").isNotNull(), F.pmod(F.floor(F.col("vec_id") / 10), F.lit(DROPPED)) + 1).otherwise(F.lit(0)).cast("int")
    out = both.select("vec_id", F.struct(F.coalesce("led", "embedding").alias("vector"), drop.alias("drop"), F.pmod("vec_id", F.lit(1 << 31)).alias("seed")).alias("audio"))
    # rows are small and the work on each is not, so a join's merged partitions would leave it to a task or two
    return out.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def played(cell: dict | None) -> bytes | None:
    """The recording of a cell of ``recordings``."""
    if cell is None:
        return None
    return tune(cell["vector"], drop=cell["drop"], noise=NOISE if cell["drop"] else 0.0, seed=cell["seed"] or 0)


def media_fingerprints(vectors: DataFrame) -> DataFrame:
    """Every row of ``embeddings`` as a recording, with every match; queries are the ids divisible by 100."""
    return all_matches(recordings(vectors), "vec_id", "audio", F.col("id") % 100 == 0, reader=played).withColumnRenamed("id", "vec_id")
